"""Items by group, and objects whose values hold arrays."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import QueryError
from docframe.functions.paths import strict

from .base import DOC, GROUP, GROUP_POS, HIDDEN, ITEM_POS, Camel, Order, Rows, Values, numbered, plain, quoted, visible

if TYPE_CHECKING:
    from .items import Items


@dataclass(frozen=True, eq=False)
class Groups(Camel):
    """The result of ``group_by``: a table of groups, or aggregates of each."""

    query: Items
    key: Column

    def agg(self, **results: Column) -> DataFrame:
        """One row per group: key and results, aggregated before anything is sent."""
        return self.query._rows().groupBy(self.key.alias("key")).agg(*[c.alias(n) for n, c in results.items()])

    def aggregate(self, **paths: tuple[str, str]) -> DataFrame:
        """One row per group with results such as ``total=("sum", "price")``: sum, average, min, max or count."""
        from .aggregate import mean, numbers, total

        q = self.query
        make = {"sum": lambda p: total(q, p), "average": lambda p: mean(q, p), "min": lambda p: F.min(numbers(q, p)), "max": lambda p: F.max(numbers(q, p)), "count": lambda p: F.count(F.lit(1))}
        return self.agg(**{name: make[how](path) for name, (how, path) in paths.items()})

    def count(self) -> DataFrame:
        return self.agg(count=F.count(F.lit(1)))

    def all(self) -> DataFrame:
        """(key, items): groups by their first item, items in order. A group is one value here; :meth:`agg` needs no such thing."""
        rows, order = self.query._rows(), self.query._order()
        if any(not up for _, up in order.keys):
            rows, order = numbered(rows, order, HIDDEN + "place"), Order(((HIDDEN + "place", True),))
        at = F.struct(*[F.struct(quoted(k).isNull(), quoted(k)) for k, _ in order.keys])
        item = quoted("value") if self.query.scalar else F.struct(*[quoted(c) for c in visible(self.query.df)])
        found = rows.groupBy(self.key.alias("key")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), item.alias("item")))).alias("x"), F.min(at).alias("first"))
        return found.orderBy("first").select("key", F.transform("x", lambda e: e["item"]).alias("items"))

    def to_dict(self) -> dict[str, list]:
        return {r["key"]: [plain(x) for x in r["items"]] for r in self.all().collect()}


def merged(kinds: list[T.DataType]) -> T.DataType:
    """A type that values of all ``kinds`` can have; structs get all fields of all, and null is of any type."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)] or [T.NullType()]
    first = kinds[0]
    if all(k == first for k in kinds):
        return first
    if all(isinstance(k, T.StructType) for k in kinds):
        names = list(dict.fromkeys(n for k in kinds for n in k.names))
        return T.StructType([T.StructField(n, merged([k[n].dataType for k in kinds if n in k.names])) for n in names])
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return T.ArrayType(merged([k.elementType for k in kinds]))
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.LongType() if all(isinstance(k, T.IntegralType) for k in kinds) else T.DoubleType()
    return T.StringType()


def conform(col: Column, kind: T.DataType, to: T.DataType) -> Column:
    if kind == to:
        return col
    if isinstance(to, T.StructType) and isinstance(kind, T.StructType):
        fields = [(conform(col.getField(f.name), kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(to, T.ArrayType) and isinstance(kind, T.ArrayType):
        return F.transform(col, lambda e: conform(e, kind.elementType, to.elementType))
    return F.to_json(col) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else col.cast(to)


def entries_of(col: Column, kind: T.DataType) -> tuple[Column, T.DataType] | None:
    """array<struct<key, value>> of an object in the order of its keys, and the type of its values."""
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.map_entries(col), kind.valueType
    if isinstance(kind, T.StructType):
        to = merged([f.dataType for f in kind.fields]) if kind.fields else T.StringType()
        # an absent group is null in all rows, so it is none
        made = F.array(*[F.when(col.getField(f.name).isNotNull(), F.struct(F.lit(f.name).alias("key"), conform(col.getField(f.name), f.dataType, to).alias("value"))) for f in kind.fields])
        return F.filter(made, lambda e: e.isNotNull()), to
    return None


@dataclass(frozen=True, eq=False)
class ObjectGroups(Camel):
    """The groups of an object: its keys and values. ``df`` has key, value and the hidden order."""

    df: DataFrame
    root_path: str
    included: tuple[str, ...] | None = None
    excluded: tuple[str, ...] = ()

    ORDER = Order(((DOC, True), (GROUP_POS, True)))

    def include(self, keys: Iterable[str]) -> ObjectGroups:
        """Only these keys; a second call replaces the first."""
        return replace(self, included=tuple(keys))

    def exclude(self, keys: Iterable[str]) -> ObjectGroups:
        return replace(self, excluded=tuple(keys))

    def _rows(self) -> DataFrame:
        df = self.df
        if self.included is not None:
            df = df.filter(F.col("key").isin(*self.included) if self.included else F.lit(False))
        return df.filter(~F.col("key").isin(*self.excluded)) if self.excluded else df

    def entries(self) -> Rows:
        return Rows(self._rows(), self.ORDER)

    def values(self) -> Values:
        return Values(self._rows().drop("key"), self.ORDER)

    def arrays(self, path: str) -> Items:
        """All groups' arrays at a path as one, group after group; each item's source is kept."""
        from .items import Origin
        from .root import spread

        value = self.df.schema["value"].dataType
        col, kind = strict(F.col("value"), value, path)
        message = F.concat(F.lit(f'Expected array at path "{path}" in group "'), F.col("key"), F.lit('".'))
        if not isinstance(kind, T.ArrayType):
            raise QueryError(f'Expected array at path "{path}" in group "{self.df.first()["key"]}".')
        array = F.when(col.isNull(), F.raise_error(message)).otherwise(col)
        rows = self._rows().select(DOC, GROUP_POS, F.col("key").alias(GROUP), F.posexplode(array).alias(ITEM_POS, "value"))
        order = Order(((DOC, True), (GROUP_POS, True), (ITEM_POS, True)))
        return spread(rows, order, Origin(path, self.root_path), placed=False)

    flat_array = arrays

    def random_entry(self, seed: int | None = None) -> tuple[str, object]:
        found = self._rows().orderBy(F.rand() if seed is None else F.rand(seed)).limit(1).collect()
        if not found:
            raise QueryError("No group entries found for randomEntry().")
        return found[0]["key"], plain(found[0]["value"])

    def random_value(self, seed: int | None = None) -> object:
        return self.random_entry(seed)[1]
