"""Relational functions."""
