"""Queries of an array's items: conditions, order, selection, aggregates, projections, positions and transforms.

A query is immutable and lazy: every step returns a new one, and Catalyst sees one plan. Items with fields are rows with these columns;
other items are rows with one column ``value``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docframe.errors import PathError, QueryError
from docframe.functions import coerce
from docframe.functions import predicates as P
from docframe.functions.paths import deep_values, found_types, matches, occurrences, strict
from docframe.plans import expression, mongo

from . import folds
from .aggregate import Aggregate
from .base import FEW, GROUP, HIDDEN, ITEM_POS, POS, Indices, Order, Paths, Rows, Values, no_stream, numbered, quoted, visible
from .groups import Groups
from .where import Where


class RowRoot:
    """The fields of a row as those of a struct, without building one."""

    def getField(self, name: str) -> Column:  # noqa: N802
        return quoted(name)


class Item:
    """An item in a function: ``item["a.b"]`` is the column at a strict path, ``item.col`` the whole item."""

    def __init__(self, query: Items) -> None:
        self._query = query

    def __getitem__(self, path: str) -> Column:
        return self._query.column(path)[0]

    @property
    def col(self) -> Column:
        return self._query.column("")[0]

    @property
    def index(self) -> Column:
        """The item's place; it is there where a step says so."""
        return quoted(HIDDEN + "index")


@dataclass(frozen=True)
class Origin:
    """Where items are from: the array's path, and that of the object whose groups hold such arrays."""

    array_path: str = ""
    groups_path: str | None = None


@dataclass(frozen=True, eq=False)
class Items(Rows):
    clauses: tuple[Column, ...] = ()
    sorting: tuple[str, bool] | None = None
    origin: Origin = Origin()
    #: Whether the hidden position is the item's place in its array.
    placed: bool = False
    scalar: bool = False
    #: The order is that of the files; the column for it is added above the conditions, which so reach the scan.
    by_file: bool = False

    FIRST, LAST, RANDOM = "No matches found for first().", "No matches found for last().", "No matches found for random()."
    NONE = MANY = "Expected exactly 1 match, found {n}."

    def one(self, message: str | None = None) -> object:
        try:
            return super().one(message)
        except QueryError as e:
            raise QueryError(str(e).replace("found zero.", "found 0.")) from None

    # columns

    def kind(self) -> T.DataType:
        schema = self.df.schema
        if self.scalar:
            return schema["value"].dataType
        return T.StructType([f for f in schema.fields if not f.name.startswith(HIDDEN)])

    def column(self, path: str) -> tuple[Column, T.DataType]:
        """The column at a strict path, and its type."""
        kind = self.kind()
        if self.scalar:
            return strict(quoted("value"), kind, path)
        return strict(RowRoot(), kind, path, nullable=False) if path else (F.struct(*[quoted(n) for n in kind.names]), kind)

    def at(self, path: str, test: P.Test) -> Column:
        """Whether ``test`` holds at a predicate path."""
        root = quoted("value") if self.scalar else RowRoot() if path else self.column("")[0]
        return matches(root, self.kind(), path.split(".") if path else [], test)

    def filtered(self, condition: Column) -> Items:
        return replace(self, clauses=(*self.clauses, condition))

    # conditions

    def where(self, path: str) -> Where:
        return Where(self, path)

    def where_not(self, path: str) -> Where:
        return Where(self, path, negate=True)

    def where_in(self, path: str, values: list) -> Items:
        """Exactly one of ``values``, case included."""
        if not values:
            raise QueryError(f'whereIn("{path}") requires a non-empty array of values.')
        return self.filtered(self.at(path, P.one_of(list(values))))

    def where_all(self, values: dict[str, object]) -> Items:
        """Every path has exactly its value, case included."""
        return self.where_sift(values)

    def where_sift(self, query: dict) -> Items:
        """A query dictionary with operators such as ``$or``, ``$in`` and ``$elemMatch``."""
        return self.filtered(mongo.compiled(query, self.at))

    def filter(self, text: str, *, case_sensitive: bool = False, trim: bool = True, decimals: int | None = None) -> Items:
        """A filter expression such as ``city == 'York' and age > 30``."""
        return self.filtered(expression.compiled(text, self.at, case_sensitive=case_sensitive, trim=trim, decimals=decimals))

    def filter_if_present(self, text: str | None, **options) -> Items:
        return self.filter(text, **options) if text else self

    def where_if_present(self, path: str, value: object, **options) -> Items:
        return self if value is None else self.where(path).equals(value, **options)

    def where_not_if_present(self, path: str, value: object, **options) -> Items:
        return self if value is None else self.where(path).ne(value, **options)

    def greater_than_if_present(self, path: str, value: object) -> Items:
        return self if value is None else self.where(path).gt(value)

    def greater_than_or_equal_if_present(self, path: str, value: object) -> Items:
        return self if value is None else self.where(path).gte(value)

    def less_than_if_present(self, path: str, value: object) -> Items:
        return self if value is None else self.where(path).lt(value)

    def less_than_or_equal_if_present(self, path: str, value: object) -> Items:
        return self if value is None else self.where(path).lte(value)

    def contains_if_present(self, path: str, value: str | None, **options) -> Items:
        return self if value is None else self.where(path).contains(value, **options)

    def not_contains_if_present(self, path: str, value: str | None, **options) -> Items:
        return self if value is None else self.where_not(path).contains(value, **options)

    def starts_with_if_present(self, path: str, value: str | None, **options) -> Items:
        return self if value is None else self.where(path).starts_with(value, **options)

    def not_starts_with_if_present(self, path: str, value: str | None, **options) -> Items:
        return self if value is None else self.where_not(path).starts_with(value, **options)

    def ends_with_if_present(self, path: str, value: str | None, **options) -> Items:
        return self if value is None else self.where(path).ends_with(value, **options)

    def not_ends_with_if_present(self, path: str, value: str | None, **options) -> Items:
        return self if value is None else self.where_not(path).ends_with(value, **options)

    # rows and their order

    def sort(self, path: str, direction: str = "asc") -> Items:
        """By one path, nulls last either way, ties in their old order; the last call counts. No path, no change."""
        if not path:
            return self
        self.column(path)
        return replace(self, sorting=(path, direction == "asc"))

    def _sort_name(self) -> str:
        return f"{HIDDEN}sort{len(self.order.keys)}"

    def _rows(self) -> DataFrame:
        df = self.df
        for c in self.clauses:
            df = df.filter(c)
        if self.by_file and not df.isStreaming:
            df = df.withColumn(POS, F.monotonically_increasing_id())
        return df.withColumn(self._sort_name(), self.column(self.sorting[0])[0]) if self.sorting else df

    def _order(self) -> Order:
        return Order(((self._sort_name(), self.sorting[1]), *self.order.keys)) if self.sorting else self.order

    def _fresh(self, df: DataFrame, order: Order | None = None, **more) -> Items:
        """A query of what a step has made, in the order of its rows."""
        return Items(df, order or self._order(), **more)

    def _kept(self, df: DataFrame) -> Items:
        return self._fresh(df, scalar=self.scalar)

    def _hidden(self, order: Order | None = None) -> list[Column]:
        return [quoted(k) for k, _ in (order or self._order()).keys]

    def cache(self) -> Items:
        """The matching rows stay in the cluster's memory or on its disks, for several endings."""
        return self._kept(self._rows().persist())

    def exists(self) -> bool:
        return not self._rows().isEmpty()

    def any(self) -> object:
        """As :meth:`first`."""
        return self.first()

    def every(self) -> bool:
        """Whether all items match, as they do where there is none."""
        if not self.clauses:
            return True
        condition = self.clauses[0]
        for c in self.clauses[1:]:
            condition = condition & c
        return self.df.filter(P.negated(condition)).isEmpty()

    def take(self, n: int) -> Items:
        return self._kept(self._rows().orderBy(*self._order().columns()).limit(max(0, n)))

    def drop(self, n: int) -> Items:
        """All but the first n: what isn't before the row at place n; beyond ``FEW`` rows, by ranges that are numbered each on its own."""
        if n <= 0:
            return self._kept(self._rows())
        rows, order = self._rows(), self._order()
        no_stream(rows, "drop")
        if n > FEW:
            return self._kept(numbered(rows, order, HIDDEN + "place").filter(quoted(HIDDEN + "place") >= n).drop(HIDDEN + "place"))
        at = rows.select(*self._hidden()).orderBy(*order.columns()).offset(n).limit(1).collect()
        return self._kept(rows.filter(order.beyond(at[0], including=True) if at else F.lit(False)))

    def _stop(self, fn: Callable[[Item], Column]) -> list:
        """The order of the first row that fails ``fn``, if one does."""
        rows = self._rows()
        no_stream(rows, "a prefix")
        return rows.filter(P.negated(fn(Item(self)))).select(*self._hidden()).orderBy(*self._order().columns()).limit(1).collect()

    def take_while(self, fn: Callable[[Item], Column]) -> Items:
        at = self._stop(fn)
        return self._kept(self._rows().filter(~self._order().beyond(at[0], including=True)) if at else self._rows())

    def drop_while(self, fn: Callable[[Item], Column]) -> Items:
        at = self._stop(fn)
        return self._kept(self._rows().filter(self._order().beyond(at[0], including=True) if at else F.lit(False)))

    def partition(self, fn: Callable[[Item], Column]) -> tuple[Items, Items]:
        """(matching, others)."""
        found = P.known(fn(Item(self)))
        return self._kept(self._rows().filter(found)), self._kept(self._rows().filter(~found))

    # aggregates

    def aggregate(self) -> Aggregate:
        """Several aggregates in one pass."""
        return Aggregate(self)

    def sum(self, path: str) -> float:
        return self.aggregate().sum(path).value()

    def average(self, path: str) -> float:
        return self.aggregate().average(path).value()

    def min(self, path: str) -> float | None:
        return self.aggregate().min(path).value()

    def max(self, path: str) -> float | None:
        return self.aggregate().max(path).value()

    def sum_of_products(self, *paths: str) -> float:
        return self.aggregate().sum_of_products(*paths).value()

    def group_by(self, path: str) -> Groups:
        """Items by the text of the value at a path; null is the group ``null``."""
        col, kind = self.column(path)
        return Groups(self, F.coalesce(coerce.string(col, kind), F.lit("null")))

    def distinct(self, path: str | None = None) -> Items:
        """The first item of each value: of the whole item, at a path with dots, or of the field of that name at any depth."""
        if path is None:
            keys = [(quoted(n), self.df.schema[n].dataType) for n in visible(self.df)]
        elif "." in path or self.scalar:
            keys = [self.column(path)]
        else:
            found = occurrences(self.kind(), path)
            if not found:
                raise PathError(f'Path "{path}" does not exist in item (deep search). Use a dot-path if needed.')
            many = F.raise_error(F.lit(f'Path "{path}" matched multiple values in an item. Use a dot-path to disambiguate.'))
            if len(found) > 1:
                raise QueryError(f'Path "{path}" matched multiple values in an item. Use a dot-path to disambiguate.')
            if "[]" in found[0]:
                values, kind = self._deep([path])
                none = F.raise_error(F.lit(f'Path "{path}" does not exist in item (deep search). Use a dot-path if needed.'))
                keys = [(F.when(F.size(values) > 1, many).when(F.size(values) == 0, none).otherwise(F.get(values, F.lit(0))), kind)]
            else:
                keys = [self.column(found[0])]
        rows, order = self._rows(), self._order()
        no_stream(rows, "distinct")
        if any(not up for _, up in order.keys):
            rows, order = numbered(rows, order, HIDDEN + "place"), Order(((HIDDEN + "place", True),))
        for i, (c, kind) in enumerate(keys):
            rows = rows.withColumn(f"{HIDDEN}key{i}", F.to_json(c) if isinstance(kind, (T.MapType, T.VariantType)) else c)
        whole = F.struct(*[quoted(c) for c in rows.columns if not c.startswith(f"{HIDDEN}key")])
        # one partial row per value and task, whatever the number of copies
        best = rows.groupBy(*[f"{HIDDEN}key{i}" for i in range(len(keys))]).agg(F.min_by(whole, F.struct(*[F.struct(c.isNull(), c) for c in self._hidden(order)])).alias("__b"))
        return self._fresh(best.select("__b.*"), order, scalar=self.scalar)

    # projections

    def pluck(self, path: str) -> Values:
        return Values(self._rows().select(*self._hidden(), self.column(path)[0].alias("value")), self._order())

    def pick(self, *paths: str | list | dict) -> Rows:
        """Columns at paths, each called as its path is written, or by the keys of a dictionary."""
        return Rows(self._rows().select(*self._hidden(), *[self.column(p)[0].alias(name) for name, p in named(paths).items()]), self._order())

    def _deep(self, keys: list[str]) -> tuple[Column, T.DataType]:
        kind = self.kind()
        kinds = found_types(kind, keys)
        one = len({k.simpleString() for k in kinds}) == 1
        numeric = kinds and all(isinstance(k, T.NumericType) for k in kinds)
        to = kinds[0] if one else T.DoubleType() if numeric else T.StringType()
        root = quoted("value") if self.scalar else RowRoot()
        return deep_values(root, kind, keys, to.simpleString()), to

    def find_all(self, path: str) -> Values:
        """Values of a field of that name, or at a path, at any depth of the items; an outer one before those inside it."""
        values, _ = self._deep(path.split("."))
        rows = self._rows().select(*self._hidden(), F.posexplode(values).alias(HIDDEN + "deep", "value"))
        return Values(rows, Order((*self._order().keys, (HIDDEN + "deep", True))))

    # positions

    def _with_index(self) -> tuple[DataFrame, Column]:
        """The rows, and each one's place in its array before all conditions."""
        if self.placed:
            return self._rows(), quoted(POS)
        df = self.df
        if self.by_file:
            no_stream(df, "index")
            df = df.withColumn(POS, F.monotonically_increasing_id())
        base = replace(self, df=numbered(df, self.order, HIDDEN + "index"), by_file=False)
        return base._rows(), quoted(HIDDEN + "index")

    def index(self) -> Indices:
        df, index = self._with_index()
        return Indices(df.select(*self._hidden(), index.alias("index")), self._order())

    def all_with_index(self) -> Rows:
        df, index = self._with_index()
        return Rows(df.select(*self._hidden(), index.alias("index"), *[quoted(c) for c in visible(self.df)]), self._order())

    def _path(self) -> tuple[DataFrame, Column]:
        o = self.origin
        if o.groups_path is not None:
            lead = F.concat(F.lit(f"{o.groups_path}."), quoted(GROUP), F.lit(f".{o.array_path}["))
            return self._rows(), F.concat(lead, quoted(ITEM_POS).cast("string"), F.lit("]"))
        df, index = self._with_index()
        return df, F.concat(F.lit(f"{o.array_path}["), index.cast("string"), F.lit("]"))

    def path(self) -> Paths:
        df, path = self._path()
        return Paths(df.select(*self._hidden(), path.alias("path")), self._order())

    def random_with_path(self, seed: int | None = None) -> tuple[object, str]:
        df, path = self._path()
        rows = df.withColumn(HIDDEN + "path", path).orderBy(F.rand() if seed is None else F.rand(seed))
        row = self._one_row(rows, "No matches found for randomWithPath().")
        return self._value(row), row[HIDDEN + "path"]

    # transforms

    def _made(self, df: DataFrame, made: Column | dict[str, Column], order: Order) -> Items:
        if isinstance(made, dict):
            return self._fresh(df.select(*self._hidden(order), *[c.alias(n) for n, c in made.items()]), order)
        out = df.select(*self._hidden(order), made.alias("value"))
        kind = out.schema["value"].dataType
        if isinstance(kind, T.StructType):
            return self._fresh(out.select(*self._hidden(order), *[F.col("value").getField(n).alias(n) for n in kind.names]), order)
        return self._fresh(out, order, scalar=True)

    def _applied(self, fn: Callable[[dict | object], object], schema: str, many: bool) -> Items:
        """A Python function over rows, in Arrow batches; ``schema`` declares what it returns."""
        rows, order = self._rows(), self._order()
        kind = T._parse_datatype_string(schema)
        struct = isinstance(kind, T.StructType)
        fields = list(kind.fields) if struct else [T.StructField("value", kind)]
        declared = T.StructType([*[rows.schema[k] for k, _ in order.keys], *fields, *[T.StructField(HIDDEN + "sub", T.IntegerType())] * many])
        shown, hidden, sub, scalar = visible(self.df), [k for k, _ in order.keys], HIDDEN + "sub", self.scalar
        names, arrow = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

        def run(batches):
            for b in batches:
                take, subs, out = [], [], [[] for _ in names]
                # plain values: a null is None, whatever the column's type
                for k, r in enumerate(b.to_pylist(maps_as_pydicts="lossy")):
                    result = fn(r["value"] if scalar else {c: r[c] for c in shown})
                    for i, x in enumerate(result if many else [result]):
                        take.append(k)
                        subs.append(i)
                        for n, own in zip(names, out, strict=True):
                            own.append(x[n] if struct else x)
                at = pa.array(take, pa.int32())
                made = [pa.array(own, t) for own, t in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in hidden], *made, *[pa.array(subs, pa.int32())] * many], [*hidden, *names, *[sub] * many])

        df = rows.mapInArrow(run, declared)
        return self._fresh(df, Order((*order.keys, (sub, True))) if many else order, scalar=not struct)

    def map(self, fn: Callable, schema: str | None = None) -> Items:
        """Each item becomes what ``fn(item)`` says: a column, or columns by name. With ``schema``, ``fn`` is plain Python."""
        return self._applied(fn, schema, False) if schema else self._made(self._rows(), fn(Item(self)), self._order())

    def map_with_index(self, fn: Callable[[Item, Column], Column | dict]) -> Items:
        """As :meth:`map`; ``fn`` also gets the item's place among the matching ones."""
        df = numbered(self._rows(), self._order(), HIDDEN + "index")
        return self._made(df, fn(Item(self), quoted(HIDDEN + "index")), self._order())

    def map2(self, a: str, b: str, fn: Callable[[Column, Column], Column]) -> Items:
        return self.mapn([a, b], fn)

    def mapn(self, paths: list[str], fn: Callable[..., Column]) -> Items:
        return self._made(self._rows(), fn(*[self.column(p)[0] for p in paths]), self._order())

    def flat_map(self, fn: Callable, schema: str | None = None) -> Items:
        """Each item becomes the elements of an array, or characters of a text; none for an empty one."""
        if schema:
            return self._applied(fn, schema, True)
        made, order, sub = fn(Item(self)), self._order(), f"{HIDDEN}sub{len(self._order().keys)}"
        rows = self._rows().withColumn(HIDDEN + "many", made)
        kind = rows.schema[HIDDEN + "many"].dataType
        many = quoted(HIDDEN + "many")
        if isinstance(kind, T.StringType):
            many = F.filter(F.split(many, ""), lambda c: c != "")
        elif not isinstance(kind, T.ArrayType):
            raise QueryError(f"flatMap() needs an array, not {kind.simpleString()}")
        longer = Order((*order.keys, (sub, True)))
        exploded = rows.select(*self._hidden(), F.posexplode(many).alias(sub, "value"))
        return self._made(exploded, F.col("value"), longer)

    # folds

    def reduce(self, fn: Callable, init: object, *, plain: bool = False) -> object:
        """A left fold in order: see :mod:`docframe.operators.folds` for what runs distributed. With ``plain``, ``fn`` is plain Python."""
        return folds.fold(self, fn, init, plain=plain)

    fold = reduce

    def reduce2(self, a: str, b: str, fn: Callable, init: object, *, plain: bool = False) -> object:
        return self.reducen([a, b], fn, init, plain=plain)

    fold2 = reduce2

    def reducen(self, paths: list[str], fn: Callable, init: object, *, plain: bool = False) -> object:
        return folds.fold(self, fn, init, paths, plain)

    foldn = reducen

    def scan(self, fn: Callable, init: object, schema: str | None = None) -> Items:
        """All states of a left fold, the first being ``init``: one more than there are items. With ``schema``, ``fn`` is plain Python."""
        return folds.scan(self, fn, init, schema)

    # pairs

    def zip(self, other: list | Rows | DataFrame, schema: str | None = None) -> Items:
        """Pairs by place, as many as the shorter has: columns ``item`` and ``other``."""
        return self._made(*self._zipped(other, schema, lambda item, o: {"item": item, "other": o}))

    def zip_with(self, other: list | Rows | DataFrame, fn: Callable[[Item, Column], Column | dict], schema: str | None = None) -> Items:
        return self._made(*self._zipped(other, schema, None, fn))

    def _zipped(self, other, schema, pair, fn=None):
        at = HIDDEN + "index"
        spark = self.df.sparkSession
        if isinstance(other, Rows):
            shown = visible(other._rows())
            right = numbered(other._rows(), other._order(), at)
            value = quoted(shown[0]) if shown == ["value"] else F.struct(*[quoted(c) for c in shown])
            right = right.select(at, value.alias(HIDDEN + "other"))
        else:
            kind = f"{at} bigint, {HIDDEN}other {schema}" if schema else [at, HIDDEN + "other"]
            pairs = [(i, v) for i, v in enumerate(other)]
            right = spark.createDataFrame(pairs, kind) if pairs or schema else spark.createDataFrame([], f"{at} bigint, {HIDDEN}other string")
        df = numbered(self._rows(), self._order(), at).join(right, at)
        o = quoted(HIDDEN + "other")
        made = pair(self.column("")[0], o) if pair else fn(Item(self), o)
        return df, made, self._order()


def named(paths: tuple) -> dict[str, str]:
    """{name: path} of what ``pick`` is given: paths, a list of them, or a dictionary."""
    out: dict[str, str] = {}
    for p in paths:
        out |= p if isinstance(p, dict) else {x: x for x in ([p] if isinstance(p, str) else p)}
    return out
