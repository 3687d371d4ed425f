"""Column expressions: text, dates, scores and belief masses."""
