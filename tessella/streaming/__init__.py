"""Relational streaming."""
