"""Column expressions and plain Python functions on document values."""
