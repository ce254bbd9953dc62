"""Composed plans: the build, its views and the query catalogue."""
