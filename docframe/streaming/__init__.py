"""Queries over streams: conditions and projections as they arrive, aggregates by event-time window."""

from .streams import start, windowed

__all__ = ["start", "windowed"]
