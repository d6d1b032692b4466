"""Column expressions and pure Python helpers."""
