"""Parsing and planning of statements."""
