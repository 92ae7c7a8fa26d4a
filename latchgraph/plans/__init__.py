"""Whole analyses and the queries over plain tables."""
