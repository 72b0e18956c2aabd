"""Composed plans: build, stored graph, report, query catalogue."""
