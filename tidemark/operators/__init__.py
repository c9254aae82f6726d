"""Relational operators and batch inference."""
