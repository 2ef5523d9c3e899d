"""Operators: single-pass linear algebra, Arrow passes, data generation and
comparison of results."""
