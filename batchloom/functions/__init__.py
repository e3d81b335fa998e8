"""Column expressions and small pure-Python value helpers."""
