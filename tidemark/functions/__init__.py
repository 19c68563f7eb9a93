"""Column-returning building blocks."""
