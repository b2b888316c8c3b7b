"""Column expressions: text, dates, states and formats."""
