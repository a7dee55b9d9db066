"""Column expressions: geography, calendar, labels, keywords."""
