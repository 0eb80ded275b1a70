"""Column expressions: guards, text, statistics, quantiles, formulas."""
