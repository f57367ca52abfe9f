"""Column functions and the few pandas helpers."""
