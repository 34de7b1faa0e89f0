"""Column expressions: text, dates, distributions, scores, answer parsing."""
