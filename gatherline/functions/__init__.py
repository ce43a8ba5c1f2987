"""Column expressions: scores, guards, reproducible draws and distribution functions."""
