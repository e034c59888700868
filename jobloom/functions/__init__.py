"""Column expressions: occupation codes, text, URLs and vectors."""
