"""Relational operators and the after-images of changes."""
