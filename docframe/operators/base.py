"""Names, ordered rows and what all queries end with."""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docframe.errors import QueryError

#: Columns that carry order and origin; items never show them.
HIDDEN = "__df_"
POS, GROUP, GROUP_POS, ITEM_POS, DOC = (HIDDEN + x for x in ("pos", "group", "group_pos", "item_pos", "doc"))
#: Rows of a range that one task numbers.
RANGE_ROWS = 1_000_000
#: Places up to which the first rows are brought together to find the one there.
FEW = 10_000


class Camel:
    """Every method is also known by its name in camel case: ``where_in`` and ``whereIn``, ``not_`` and ``not``."""

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        snake = re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)
        for other in (snake, f"{snake}_"):
            if other != name and hasattr(type(self), other):
                return getattr(self, other)
        raise AttributeError(f"{type(self).__name__} has no {name}")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Order:
    """Columns that decide the order of rows, the first first; nulls come last either way."""

    keys: tuple[tuple[str, bool], ...] = ()

    def columns(self, back: bool = False) -> list[Column]:
        """Sort columns; ``back`` is the exact reverse."""
        out = []
        for name, up in self.keys:
            c = quoted(name)
            out.append((c.desc_nulls_first() if up else c.asc_nulls_first()) if back else c.asc_nulls_last() if up else c.desc_nulls_last())
        return out

    def beyond(self, row: Row, *, including: bool) -> Column:
        """Whether a row comes after ``row`` (or is its equal)."""
        out = F.lit(including)
        for name, up in reversed(self.keys):
            c, v = quoted(name), row[name]
            same = c.isNull() if v is None else F.coalesce(c == F.lit(v), F.lit(False))
            after = F.lit(False) if v is None else c.isNull() | F.coalesce(c > F.lit(v) if up else c < F.lit(v), F.lit(False))
            out = after | (same & out)
        return out


def numbered(df: DataFrame, order: Order, name: str) -> DataFrame:
    """Adds ``name``: the gapless place of a row, from 0.

    Ranges of about ``RANGE_ROWS`` rows are numbered each on its own, so no task sees all rows: the first row of each range is
    found by a range partitioning, rows are dealt out by these, and the ranges' counts give the offsets.
    """
    no_stream(df, name.removeprefix(HIDDEN))
    parts = min(4096, math.ceil(df.count() / RANGE_ROWS))
    if parts <= 1:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order.columns())) - 1).cast("long"))
    keys = [quoted(k) for k, _ in order.keys]
    sorted_parts = df.select(*keys).repartitionByRange(parts, *order.columns()).sortWithinPartitions(*order.columns())
    firsts = sorted_parts.groupBy(F.spark_partition_id().alias("p")).agg(F.first(F.struct(*keys)).alias("r")).collect()  # a row per range
    bounds = [r.r for r in firsts]
    place = functools.reduce(operator.add, [order.beyond(r, including=True).cast("int") for r in bounds]) - 1
    dealt = df.withColumn(HIDDEN + "range", place)
    counts = {r[0]: r["count"] for r in dealt.groupBy(HIDDEN + "range").count().collect()}
    offsets, total = {}, 0
    for k in sorted(counts):
        offsets[k], total = total, total + counts[k]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col(HIDDEN + "range"))
    own = Window.partitionBy(HIDDEN + "range").orderBy(*order.columns())
    return dealt.withColumn(name, (F.row_number().over(own) - 1 + offset).cast("long")).drop(HIDDEN + "range")


def no_stream(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise QueryError(f"{what} needs the order of all rows, which a stream doesn't have")


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


@dataclass(frozen=True, eq=False)
class Rows(Camel):
    """Ordered rows, and what a query of them may end with. ``df`` also has the hidden columns of the order."""

    df: DataFrame
    order: Order

    #: The column that is a row's value if it is the only one.
    ONLY = "value"
    #: How messages name what is missing.
    FIRST = LAST = RANDOM = "No matching items found"
    NTH = "Index {index} out of bounds. Found {n} matches."
    NONE = MANY = "Expected exactly one matching item, but found {n}"

    def _rows(self) -> DataFrame:
        """The rows that the query keeps, hidden columns included."""
        return self.df

    def _order(self) -> Order:
        return self.order

    def _value(self, row: Row) -> object:
        """What a row is to the caller."""
        own = {k: v for k, v in row.asDict().items() if not k.startswith(HIDDEN)}
        return plain(own[self.ONLY]) if set(own) == {self.ONLY} else plain(own)

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.select(*[quoted(c) for c in visible(df)])

    def unordered(self) -> DataFrame:
        """The rows without an order: for writing, joining and aggregating."""
        return self._shown(self._rows())

    def all(self) -> DataFrame:
        """The rows in order, as a DataFrame."""
        rows = self._rows()
        no_stream(rows, "all")
        return self._shown(rows.orderBy(*self._order().columns()))

    def to_list(self) -> list:
        """All values on the driver."""
        return [self._value(r) for r in self.all().collect()]

    def _one_row(self, df: DataFrame, message: str) -> Row:
        found = df.limit(1).collect()
        if not found:
            raise QueryError(message)
        return found[0]

    def first(self) -> object:
        return self._value(self._one_row(self._rows().orderBy(*self._order().columns()), self.FIRST))

    def last(self) -> object:
        return self._value(self._one_row(self._rows().orderBy(*self._order().columns(back=True)), self.LAST))

    def nth(self, index: int) -> object:
        """The row at a place from 0."""
        rows, order = self._rows(), self._order()
        if index > FEW:
            place = HIDDEN + "place"
            found = numbered(rows, order, place).filter(quoted(place) == index).drop(place).collect()
        else:
            found = rows.orderBy(*order.columns()).offset(index).limit(1).collect() if index >= 0 else []
        if not found:
            raise QueryError(self.NTH.format(index=index, n=rows.count()))
        return self._value(found[0])

    def random(self, seed: int | None = None) -> object:
        """Any row, each as likely as another."""
        rand = F.rand() if seed is None else F.rand(seed)
        return self._value(self._one_row(self._rows().orderBy(rand), self.RANDOM))

    def one(self, message: str | None = None) -> object:
        """The only row."""
        rows = self._rows()
        found = rows.limit(2).collect()
        if len(found) != 1:
            n = "zero" if not found else rows.count()
            raise QueryError(message or (self.NONE if not found else self.MANY).format(n=n))
        return self._value(found[0])

    def count(self) -> int:
        return self._rows().count()


def plain(v: object) -> object:
    """Rows as dictionaries, all the way down."""
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


@dataclass(frozen=True, eq=False)
class Indices(Rows):
    """Places of items in their array; one column ``index``."""

    ONLY = "index"


@dataclass(frozen=True, eq=False)
class Paths(Rows):
    """Paths of items from the root; one column ``path``."""

    ONLY = "path"

    NTH = "Index {index} out of bounds. Found {n} paths."


@dataclass(frozen=True, eq=False)
class Values(Rows):
    """Values at a path; one column ``value``."""

    FIRST, LAST, RANDOM = "No values found for first()", "No values found for last()", "No values found for random()"
    NTH = "Index {index} out of bounds. Found {n} values."
    NONE = MANY = "Expected exactly one value, but found {n}"

    def _map(self, fn: Callable[[Column, T.DataType], Column]) -> Values:
        return replace(self, df=self.df.withColumn("value", fn(F.col("value"), self.df.schema["value"].dataType)))

    def string(self) -> Values:
        """Values as texts, null as the empty one; what has fields or elements has no text."""
        from docframe.functions.coerce import is_complex, string

        if is_complex(kind := self.df.schema["value"].dataType):
            raise QueryError(f"Cannot convert object to string: {kind.simpleString()}. Objects must be converted manually.")
        return self._map(lambda c, k: F.coalesce(string(c, k), F.lit("")))

    def number(self) -> Values:
        """Values as doubles; null, and what isn't a number, fails when the query runs."""
        from docframe.functions.coerce import number, string

        def read(c: Column, k: T.DataType) -> Column:
            n = number(c, k)
            nan = F.raise_error(F.concat(F.lit('Cannot convert "'), F.coalesce(string(c, k), F.lit("")), F.lit('" to number. Value is NaN after conversion.')))
            return F.when(n.isNull(), F.raise_error(F.lit("Cannot convert null to number. Use filter to remove null/undefined values."))).when(F.isnan(n), nan).otherwise(n)

        return self._map(read)
