"""Graphs: JSON nodes and edges in append logs, and typed tables seen as a graph."""
