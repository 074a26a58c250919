"""Scalar functions: geometry, projections, names and labels."""
