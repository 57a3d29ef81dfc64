"""Column expressions: time, numbers, clinical rules and code lists."""
