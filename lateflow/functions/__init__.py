"""Column expressions, exact rounding and the chi-square tail probability."""
