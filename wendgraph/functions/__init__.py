"""Column functions of keys, weights and attributes."""
