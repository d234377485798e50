"""Several aggregates of one query in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.errors import QueryError
from docframe.functions import coerce

from .base import Camel

if TYPE_CHECKING:
    from .items import Items


def numbers(query: Items, path: str) -> Column:
    """The value as a double, null for what is no number."""
    n = coerce.number(*query.column(path))
    return F.when(~F.isnan(n), n)


def total(query: Items, path: str) -> Column:
    return F.coalesce(F.sum(coerce.only_numbers(*query.column(path))), F.lit(0.0))


def mean(query: Items, path: str) -> Column:
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(total(query, path) / n)


def products(query: Items, paths: tuple[str, ...]) -> Column:
    if not paths:
        raise QueryError("sumOfProducts() requires at least one path")
    out = F.lit(1.0)
    for p in paths:
        n = F.coalesce(coerce.number(*query.column(p)), F.lit(0.0))
        out = out * F.when(F.isnan(n), F.raise_error(F.lit(f'Invalid number at path "{p}" for product calculation'))).otherwise(n)
    return F.coalesce(F.sum(out), F.lit(0.0))


@dataclass(frozen=True, eq=False)
class Aggregate(Camel):
    """Each step adds a result under its own name (or ``alias``); a later one of that name replaces it."""

    query: Items
    results: dict[str, Column] = field(default_factory=dict)

    def _add(self, name: str, col: Column) -> Aggregate:
        return replace(self, results=self.results | {name: col})

    def sum(self, path: str, *, alias: str = "sum") -> Aggregate:
        """Of what is a number; all else counts 0."""
        return self._add(alias, total(self.query, path))

    def average(self, path: str, *, alias: str = "average") -> Aggregate:
        """The sum by the number of all items, those without a number included; 0 where there is none."""
        return self._add(alias, mean(self.query, path))

    def min(self, path: str, *, alias: str = "min") -> Aggregate:
        """The least of what can be read as a number."""
        return self._add(alias, F.min(numbers(self.query, path)))

    def max(self, path: str, *, alias: str = "max") -> Aggregate:
        return self._add(alias, F.max(numbers(self.query, path)))

    def sum_of_products(self, *paths: str, alias: str = "sumOfProducts") -> Aggregate:
        """The sum over items of the product of their numbers; null counts 0, what is no number fails."""
        return self._add(alias, products(self.query, paths))

    def count(self, *, alias: str = "count") -> Aggregate:
        return self._add(alias, F.count(F.lit(1)))

    def df(self) -> DataFrame:
        """One row with a column for each result."""
        return self.query._rows().agg(*[c.alias(n) for n, c in self.results.items()])

    def all(self) -> dict[str, object]:
        return self.df().first().asDict() if self.results else {}

    def value(self) -> object:
        """The only result."""
        return next(iter(self.all().values()))
