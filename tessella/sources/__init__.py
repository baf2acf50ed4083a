"""Relational sources."""
