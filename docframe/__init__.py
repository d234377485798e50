"""Queries of nested documents and tables through a fluent, lazy API, on Spark."""

from .errors import ExpressionError, PathError, QueryError
from .functions.paths import get_path_segment_after, path_segment_after
from .operators.root import query
from .sources import from_json, read, read_json, read_stream, write

__all__ = ["ExpressionError", "PathError", "QueryError", "from_json", "get_path_segment_after", "path_segment_after", "query", "read", "read_json", "read_stream", "write"]
