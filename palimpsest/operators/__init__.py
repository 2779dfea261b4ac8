"""Relational operators of the metadata engine."""
