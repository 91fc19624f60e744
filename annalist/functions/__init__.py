"""Column expressions: text, dates, arrays and records."""
