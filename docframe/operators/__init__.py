"""Queries and their steps."""
