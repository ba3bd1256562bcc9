"""Operators on tiles, windows, outliers, clusters, events and measurements."""
