"""Column expressions: codes, names, text rules, severity scales."""
