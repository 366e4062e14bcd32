"""Column functions and parameter formulas."""
