"""Column expressions: statistics, parsing, text."""
