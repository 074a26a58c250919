"""Readers and writers of grids, polygons, configuration and results."""
