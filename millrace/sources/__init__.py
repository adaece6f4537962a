"""Stored tables and sources of statements."""
