"""Conditions on one value, as columns that are true, or false or null: bare, so that scans can be given them.

Each returns a test for :func:`docframe.functions.paths.matches`. A value of another type than the operand's doesn't match; negations,
by :func:`negated`, are complements, so they match null and missing values.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import ExpressionError

from .coerce import rounded, variant_is
from .paths import Test

NO, YES = False, True
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _lit(x: bool) -> Column:
    return F.lit(x)


def known(cond: Column) -> Column:
    """The condition, false where it is null."""
    return F.coalesce(cond, F.lit(False))


def negated(cond: Column) -> Column:
    """The complement: true where the condition is null."""
    return ~known(cond)


def _same_kind(col: Column, kind: T.DataType, value: object) -> Column | None:
    """The column to compare with ``value``, or None if its type can't be equal to that of ``value``."""
    what = "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float, Decimal)) else "string" if isinstance(value, str) else "date" if isinstance(value, (dt.date, dt.datetime)) else ""
    if isinstance(kind, T.VariantType):
        as_type = {"boolean": "boolean", "number": "double", "string": "string", "date": "timestamp"}.get(what)
        return F.when(variant_is(col, what), F.try_variant_get(col, "$", as_type)) if as_type else None
    fits = {"boolean": T.BooleanType, "number": T.NumericType, "string": T.StringType, "date": _DATES}.get(what)
    return col if fits and isinstance(kind, fits) else None


def equal(value: object) -> Test:
    """Exactly ``value``; None is null and missing."""

    def test(col: Column | None, kind: T.DataType) -> Column:
        if value is None:
            if col is None:
                return _lit(True)
            return col.isNull() | F.coalesce(F.is_variant_null(col), F.lit(False)) if isinstance(kind, T.VariantType) else col.isNull()
        if col is None:
            return _lit(False)
        if isinstance(value, (list, tuple, dict)):
            import json

            return F.to_json(col) == json.dumps(value, separators=(",", ":"), ensure_ascii=False) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else _lit(False)
        own = _same_kind(col, kind, value)
        return _lit(False) if own is None else own == F.lit(value)

    return test


def one_of(values: list) -> Test:
    """Any of ``values``; patterns among them match as :func:`like`."""
    patterns = [like(v) for v in values if isinstance(v, re.Pattern)]
    plain = [v for v in values if not isinstance(v, re.Pattern)]

    def test(col: Column | None, kind: T.DataType) -> Column:
        out = _lit(False)
        groups: dict[str, list] = {}
        for v in plain:
            own = None if col is None or v is None or isinstance(v, (list, dict)) else _same_kind(col, kind, v)
            if own is None:
                out = out | equal(v)(col, kind)
            else:
                groups.setdefault(type(v).__name__, []).append(v)
        for own_values in groups.values():
            out = out | _same_kind(col, kind, own_values[0]).isin(own_values)
        for p in patterns:
            out = out | p(col, kind)
        return out

    return test


def compared(op: str, value: object) -> Test:
    """gt, gte, lt or lte, of values of one type; NaN and null match none."""

    def test(col: Column | None, kind: T.DataType) -> Column:
        own = None if col is None or value is None else _same_kind(col, kind, value)
        if own is None or isinstance(value, float) and value != value:
            return _lit(False)
        out = {"gt": own > F.lit(value), "gte": own >= F.lit(value), "lt": own < F.lit(value), "lte": own <= F.lit(value)}[op]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out = out & ~F.isnan(own)
        return out

    return test


def _text(col: Column | None, kind: T.DataType) -> Column | None:
    if isinstance(kind, T.VariantType) and col is not None:
        return F.when(variant_is(col, "string"), F.try_variant_get(col, "$", "string"))
    return col if col is not None and isinstance(kind, T.StringType) else None


def text(mode: str, needle: str, *, ignore_case: bool = True, trim: bool = True) -> Test:
    """exact, contains, starts_with or ends_with; ``trim`` is for the needle only, and a needle is no pattern."""
    needle = needle.strip() if trim else needle
    cased = needle.lower() != needle or needle.upper() != needle

    def test(col: Column | None, kind: T.DataType) -> Column:
        own = _text(col, kind)
        if own is None:
            return _lit(False)
        # a needle without letters needs no lower case, and equality then reaches the scan
        own, want = (F.lower(own), needle.lower()) if ignore_case and cased else (own, needle)
        return {"exact": lambda: own == want, "contains": lambda: own.contains(want), "starts_with": lambda: own.startswith(want), "ends_with": lambda: own.endswith(want)}[mode]()

    return test


def java_pattern(pattern: str | re.Pattern, flags: str = "") -> str:
    """A regular expression for Spark; an end anchor means the very end."""
    if isinstance(pattern, re.Pattern):
        flags += "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & f)
        pattern = pattern.pattern
    out, at, inside = "", 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            out += "\\z" if pattern[at + 1] == "Z" and not inside else pattern[at : at + 2]
            at += 2
            continue
        inside = c == "[" or inside and c != "]"
        out += "\\z" if c == "$" and not inside and "m" not in flags else c
        at += 1
    known_flags = "".join(c for c in "ims" if c in flags)
    return (f"(?{known_flags}{'u' if 'i' in known_flags else ''})" if known_flags else "") + out


def like(pattern: str | re.Pattern, flags: str = "") -> Test:
    """A text in which the pattern is found."""
    java = java_pattern(pattern, flags)

    def test(col: Column | None, kind: T.DataType) -> Column:
        own = _text(col, kind)
        return _lit(False) if own is None else own.rlike(java)

    return test


def near(value: float, decimals: int) -> Test:
    """A number that is ``value`` after rounding both."""
    import math

    want = math.floor(value * 10**decimals + 0.5) / 10**decimals

    def test(col: Column | None, kind: T.DataType) -> Column:
        own = None if col is None else _same_kind(col, kind, 1.0)
        return _lit(False) if own is None else rounded(own.cast("double"), decimals) == want

    return test


def exists() -> Test:
    return lambda col, kind: _lit(False) if col is None else col.isNotNull()


def remainder(divisor: int, rest: int) -> Test:
    def test(col: Column | None, kind: T.DataType) -> Column:
        own = None if col is None else _same_kind(col, kind, 1)
        return _lit(False) if own is None else own % F.lit(divisor) == F.lit(rest)

    return test


TYPES = {
    "number": (T.NumericType,), "double": (T.NumericType,), "int": (T.NumericType,), "long": (T.NumericType,), "string": (T.StringType,),
    "bool": (T.BooleanType,), "boolean": (T.BooleanType,), "object": (T.StructType, T.MapType), "array": (T.ArrayType,), "date": _DATES, "null": (),
}


def of_type(name: str) -> Test:
    if name not in TYPES:
        raise ExpressionError(f'Unknown type: "{name}"')

    def test(col: Column | None, kind: T.DataType) -> Column:
        if name == "null":
            return equal(None)(col, kind)
        if col is not None and isinstance(kind, T.VariantType):
            return variant_is(col, {"double": "number", "int": "number", "long": "number", "bool": "boolean"}.get(name, name))
        return col.isNotNull() if col is not None and isinstance(kind, TYPES[name]) else _lit(False)

    return test


def size_of(n: int) -> Test:
    return lambda col, kind: F.size(col) == n if col is not None and isinstance(kind, T.ArrayType) else _lit(False)


def every_of(values: list) -> Test:
    """An array that holds each value, or a scalar that equals all."""

    def test(col: Column | None, kind: T.DataType) -> Column:
        out = _lit(bool(values))
        for v in values:
            own = equal(v)(col, kind)
            if col is not None and isinstance(kind, T.ArrayType):
                inner = equal(v)
                own = own | F.exists(col, lambda e: inner(e, kind.elementType))  # noqa: B023
            out = out & own
        return out

    return test
