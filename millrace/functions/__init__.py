"""Expressions: names, types and Spark columns."""
