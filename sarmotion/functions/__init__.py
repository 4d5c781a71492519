"""Column expressions: geometry, geodesy, statistics and complex arithmetic."""
