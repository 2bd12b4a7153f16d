"""Dialect expressions as Columns."""
