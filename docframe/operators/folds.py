"""Left folds over ordered rows.

A fold's function gets the state and the item (or columns at paths). First it is called with a stand-in for the state: if it only adds
to the state, multiplies it, or takes the greater or lesser of it and something of the item, the fold is an aggregate, and a
scan a window over ranges of rows whose totals are carried over, both distributed. Any other function has to see the rows
one after the other: it is called with plain values, in order, as the rows arrive at the driver; a scan does so in one task.
A function that asks whether a value is None can't tell by columns: ``plain=True``, for a scan a ``schema``, says that it wants plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from docframe.errors import QueryError

from .base import HIDDEN, RANGE_ROWS, Order, no_stream, numbered, quoted

if TYPE_CHECKING:
    from .items import Items


@dataclass
class State:
    """The state of a fold whose step is one of four operations with a column."""

    op: str = ""
    operand: Column | None = None

    def _step(self, op: str, other: object) -> State:
        if self.op:
            raise TypeError("more than one step")
        return State(op, other if isinstance(other, Column) else F.lit(other))

    def __add__(self, other: object) -> State:
        return self._step("sum", other)

    __radd__ = __add__

    def __sub__(self, other: object) -> State:
        return self._step("sum", -(other if isinstance(other, Column) else F.lit(other)))

    def __mul__(self, other: object) -> State:
        return self._step("product", other)

    __rmul__ = __mul__

    def max(self, other: object) -> State:
        return self._step("max", other)

    def min(self, other: object) -> State:
        return self._step("min", other)

    def aggregate(self, col: Column) -> Column:
        return {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}[self.op](col)

    def join(self, a: Column, b: Column) -> Column:
        if self.op in ("sum", "product"):
            return a + b if self.op == "sum" else a * b
        return F.greatest(a, b) if self.op == "max" else F.least(a, b)

    def join_values(self, a: object, b: object) -> object:
        if a is None or b is None:
            return b if a is None else a
        return {"sum": lambda: a + b, "product": lambda: a * b, "max": lambda: max(a, b), "min": lambda: min(a, b)}[self.op]()


def _step(query: Items, fn: Callable, paths: list[str] | None) -> State | None:
    from .items import Item

    if any(not _simple(query, p) for p in paths or []):
        return None
    try:
        found = fn(State(), *([query.column(p)[0] for p in paths] if paths else [Item(query)]))
    except QueryError:  # no such path
        raise
    except (TypeError, ValueError, AttributeError):  # what plain Python does to columns; any other error is the function's own
        return None
    return found if isinstance(found, State) and found.op else None


def _simple(query: Items, path: str) -> bool:
    query.column(path)
    return True


class PlainItem(dict):
    """A row for a plain function: fields by path."""

    def __getitem__(self, path: str):
        if path in self.keys():
            return super().__getitem__(path)
        at: object = self
        for key in path.split("."):
            at = dict.__getitem__(at, key)
        return at


def _arguments(query: Items, paths: list[str] | None):
    """The rows in order, and what a plain function gets of each."""
    rows = query._rows()
    no_stream(rows, "a fold")
    ordered = rows.orderBy(*query._order().columns())
    if paths:
        names = [f"p{i}" for i in range(len(paths))]
        return ordered.select(*[query.column(p)[0].alias(n) for p, n in zip(paths, names, strict=True)]), lambda r: [r[n] for n in names]
    value = query._value
    return ordered, lambda r: [PlainItem(v) if isinstance(v := value(r), dict) else v]


def fold(query: Items, fn: Callable, init: object, paths: list[str] | None = None, plain: bool = False) -> object:
    step = None if plain else _step(query, fn, paths)
    if step:
        found = query._rows().agg(step.aggregate(step.operand).alias("x")).first().x
        return step.join_values(init, found)
    rows, arguments = _arguments(query, paths)
    state = init
    for r in rows.toLocalIterator():  # a partition at a time
        state = fn(state, *arguments(r))
    return state


def scan(query: Items, fn: Callable, init: object, schema: str | None = None) -> Items:
    at = HIDDEN + "place"
    spark = query.df.sparkSession
    step = None if schema else _step(query, fn, None)
    if step is None:
        return _scan_rows(query, fn, init, schema)
    rows = numbered(query._rows().withColumn(HIDDEN + "x", step.operand), query._order(), at).select(at, HIDDEN + "x")
    dealt = rows.withColumn(HIDDEN + "range", F.floor(F.col(at) / RANGE_ROWS))
    carried = dealt.groupBy(HIDDEN + "range").agg(step.aggregate(F.col(HIDDEN + "x")).alias("x")).collect()  # a row per range
    before, state = {}, init
    for r in sorted(carried, key=lambda r: r[0]):
        before[r[0]] = state
        state = step.join_values(state, r.x)
    own = Window.partitionBy(HIDDEN + "range").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col(HIDDEN + "range")) if before else F.lit(init)
    states = dealt.select((F.col(at) + 1).alias(at), step.join(start, step.aggregate(F.col(HIDDEN + "x")).over(own)).alias("value"))
    kind = schema or states.schema["value"].dataType
    first = spark.range(1).select(F.lit(0).cast("long").alias(at), F.lit(init).cast(kind).alias("value"))
    out = first.union(states.withColumn("value", F.col("value").cast(kind)))
    return query._fresh(out, Order(((at, True),)), scalar=True)


def _scan_rows(query: Items, fn: Callable, init: object, schema: str | None) -> Items:
    rows, arguments = _arguments(query, None)
    at, spark = HIDDEN + "place", query.df.sparkSession
    kind = schema or {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(init)]
    shown, scalar = [c for c in query.df.columns if not c.startswith(HIDDEN)], query.scalar

    value_type = to_arrow_type(T._parse_datatype_string(kind))

    def run(batches):
        state, n = init, 0
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([init], value_type)], [at, "value"])
        for b in batches:
            out = []
            for r in b.to_pylist(maps_as_pydicts="lossy"):
                state = fn(state, r["value"] if scalar else PlainItem(r))
                out.append(state)
            yield pa.RecordBatch.from_arrays([pa.array(range(n + 1, n + 1 + len(out)), pa.int64()), pa.array(out, value_type)], [at, "value"])
            n += len(out)

    # the state passes from row to row, so one task reads the sorted rows, a batch at a time
    one = rows.select(*[quoted(c) for c in shown]).coalesce(1) if not rows.isEmpty() else None
    if one is None:
        out = spark.createDataFrame([(0, init)], f"{at} bigint, value {kind}")
    else:
        out = one.mapInArrow(run, f"{at} bigint, value {kind}")
    return query._fresh(out, Order(((at, True),)), scalar=True)
