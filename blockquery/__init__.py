"""Queries over large sorted collections of records."""
