"""Column expressions and small distributed building blocks."""
