"""Dialect syntax, planning, statistics and join order."""
