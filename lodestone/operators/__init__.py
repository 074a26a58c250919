"""Operators on grids, windows, rankings and maps."""
