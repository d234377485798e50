"""Streams of items. What needs no order of all rows (conditions, ``pluck``, ``pick``, ``map``, ``find_all``) runs on a stream as it
does on a table, through :meth:`docframe.operators.base.Rows.unordered`; everything else is refused when the query is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docframe.operators.base import Rows, quoted
from docframe.operators.items import Items


def windowed(query: Items, time: str, size: str, *, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, **results: Column) -> DataFrame:
    """Aggregates of matching items by windows of event time; items later than ``late`` are dropped, so state stays bounded."""
    rows = query.unordered()
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    window = F.window(quoted(time), size, slide) if slide else F.window(quoted(time), size)
    return rows.groupBy(window.alias("window"), *[quoted(c) for c in by or []]).agg(*[c.alias(n) for n, c in results.items()])


def start(rows: Rows | DataFrame, sink: str, *, checkpoint: str, format: str = "parquet", mode: str = "append", once: bool = False) -> StreamingQuery:
    """Write a stream to a folder; ``once`` takes what is there and ends."""
    df = rows.unordered() if isinstance(rows, Rows) else rows
    writer = df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink)
    return (writer.trigger(availableNow=True) if once else writer).start()
