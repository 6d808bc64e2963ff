"""Column expressions: targets, cleaning, rounding, bands."""
