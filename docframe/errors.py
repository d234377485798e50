"""Errors of the library."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that can't be built or whose result isn't what its last step demands."""


class PathError(QueryError):
    """A path that doesn't exist in the schema."""


class ExpressionError(QueryError):
    """A filter expression or query dictionary that can't be read."""
