"""The root of a document or a table, from which arrays, groups and fields are selected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import QueryError
from docframe.functions.paths import strict

from .base import DOC, GROUP_POS, HIDDEN, POS, Camel, Order, Rows, quoted
from .groups import ObjectGroups, entries_of
from .items import Items, Origin, RowRoot, named

#: A column of this name alone is the whole document, whatever its type.
WHOLE = "__root"


def spread(rows: DataFrame, order: Order, origin: Origin, *, placed: bool) -> Items:
    """Items from the column ``value``: their fields become columns."""
    kind = rows.schema["value"].dataType
    if not isinstance(kind, T.StructType):
        return Items(rows, order, origin=origin, placed=placed, scalar=True)
    hidden = [c for c in rows.columns if c.startswith(HIDDEN)]
    return Items(rows.select(*hidden, *[F.col("value").getField(n).alias(n) for n in kind.names]), order, origin=origin, placed=placed)


@dataclass(frozen=True, eq=False)
class Root(Camel):
    """A DataFrame whose rows are documents (mostly one), or a table whose rows are items."""

    df: DataFrame

    def raw(self) -> DataFrame:
        return self.df

    def _whole(self) -> bool:
        return self.df.columns == [WHOLE]

    def _kind(self) -> T.DataType:
        return self.df.schema[WHOLE].dataType if self._whole() else self.df.schema

    def _column(self, path: str) -> tuple[Column, T.DataType]:
        if self._whole():
            return strict(quoted(WHOLE), self._kind(), path)
        return strict(RowRoot(), self._kind(), path, nullable=False) if path else (F.struct(*[quoted(c) for c in self.df.columns]), self._kind())

    def array(self, path: str) -> Items:
        """The items of the array at a strict path."""
        col, kind = self._column(path)
        if isinstance(kind, T.VariantType):
            col, kind = F.try_variant_get(col, "$", "array<variant>"), T.ArrayType(T.VariantType())
        if not isinstance(kind, T.ArrayType):
            found = "string" if isinstance(kind, T.StringType) else "number" if isinstance(kind, T.NumericType) else "boolean" if isinstance(kind, T.BooleanType) else "object"
            raise QueryError(f'Expected array at path "{path}", but found {found}.')
        rows = self.df.select(F.monotonically_increasing_id().alias(DOC), F.posexplode(col).alias(POS, "value"))
        return spread(rows, Order(((DOC, True), (POS, True))), Origin(path), placed=True)

    def array_root(self, order_by: list[str] | None = None) -> Items:
        """The document as an array, or the table's rows as items, in the order of columns or else of the files."""
        if self._whole():
            return self.array("")
        if order_by:
            df = self.df
            for i, c in enumerate(order_by):
                df = df.withColumn(f"{HIDDEN}by{i}", quoted(c))
            return Items(df, Order(tuple((f"{HIDDEN}by{i}", True) for i in range(len(order_by)))))
        return Items(self.df, Order() if self.df.isStreaming else Order(((POS, True),)), by_file=True)

    def object_groups(self, path: str) -> ObjectGroups:
        """The keys and values of the object at a strict path."""
        col, kind = self._column(path)
        found = entries_of(col, kind)
        if not found:
            raise QueryError(f'Expected object at path "{path}".')
        rows = self.df.select(F.monotonically_increasing_id().alias(DOC), F.posexplode(found[0]).alias(GROUP_POS, "e"))
        return ObjectGroups(rows.select(DOC, GROUP_POS, F.col("e.key").alias("key"), F.col("e.value").alias("value")), path)

    def pick(self, *paths: str | list | dict) -> Rows:
        """Columns of the document at paths, as in :meth:`docframe.operators.items.Items.pick`."""
        chosen = [self._column(p)[0].alias(name) for name, p in named(paths).items()]
        return Rows(self.df.select(F.monotonically_increasing_id().alias(DOC), *chosen), Order(((DOC, True),)))


def query(source: DataFrame | Root) -> Root:
    """The root of a query over a DataFrame; :mod:`docframe.sources` makes DataFrames of JSON and files."""
    return source if isinstance(source, Root) else Root(source)
