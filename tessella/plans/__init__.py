"""Relational plans."""
