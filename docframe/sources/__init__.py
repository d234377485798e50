"""Where documents come from, and where results go."""

from .readers import from_json, read, read_json, read_stream, write

__all__ = ["from_json", "read", "read_json", "read_stream", "write"]
