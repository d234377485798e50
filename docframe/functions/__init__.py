"""Paths, coercions and conditions as columns."""
