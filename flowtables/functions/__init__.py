"""Column expressions, schema declarations and value formats."""
