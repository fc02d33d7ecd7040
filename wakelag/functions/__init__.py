"""Column expressions and scalar helpers."""
