"""Column expressions: text scalars, unit algebra, contracts and number formatting."""
