"""Logical plans of walks and their compilation to DataFrames."""
