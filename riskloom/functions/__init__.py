"""Column expressions: dates, conditional scalars, verdict bands."""
