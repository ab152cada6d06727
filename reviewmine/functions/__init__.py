"""Column expressions and small DataFrame helpers used by several operators."""
