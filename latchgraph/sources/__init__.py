"""Readers of source files, configuration, built-in tables and cached facts."""
