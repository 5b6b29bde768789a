"""Column functions: lenient numbers, dates, text keys, piecewise maps, normal distribution, valuation."""
