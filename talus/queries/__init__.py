"""Queries over grids derived from the given tables, and SQL that states the same."""
