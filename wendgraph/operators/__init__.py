"""The query surfaces: the fluent builder, the Cypher subset and the engine."""
