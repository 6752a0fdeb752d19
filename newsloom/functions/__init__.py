"""Column expressions: text, time, markup and structured data."""
