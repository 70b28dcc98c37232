"""Column expressions: text, dates and scores."""
