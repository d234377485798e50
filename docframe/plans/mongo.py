"""Query dictionaries in the style of document databases, compiled to conditions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import ExpressionError
from docframe.functions import predicates as P
from docframe.functions.paths import Test, matches

#: Resolves a predicate path: (path, test) to a condition.
Resolve = Callable[[str, Test], Column]


def compiled(query: object, at: Resolve) -> Column:
    """The condition of a query; all its keys must hold."""
    if isinstance(query, re.Pattern) or not isinstance(query, dict):
        return at("", P.like(query) if isinstance(query, re.Pattern) else P.equal(query))
    out = F.lit(True)
    for key, value in query.items():
        out = out & (_logical(key, value, at) if key.startswith("$") else _field(key, value, at))
    return out


def _logical(key: str, value: object, at: Resolve) -> Column:
    if key in ("$and", "$or", "$nor"):
        parts = [compiled(q, at) for q in value]
        if key == "$and":
            return _fold(parts, True)
        some = _fold(parts, False)
        return some if key == "$or" else P.negated(some)
    if key == "$not":
        return P.negated(compiled(value, at))
    if key == "$where":
        return _where(value, at)
    return _operators({key: value}, "", at)


def _fold(parts: list[Column], all_of: bool) -> Column:
    out = F.lit(all_of)
    for p in parts:
        out = out & p if all_of else out | p
    return out


def _where(value: object, at: Resolve) -> Column:
    if not callable(value):
        raise ExpressionError("$where takes a function of a column; texts of code are not run")
    return at("", lambda col, kind: value(col) if col is not None else F.lit(False))


def _field(path: str, value: object, at: Resolve) -> Column:
    if isinstance(value, dict) and value and all(k.startswith("$") for k in value):
        return _operators(value, path, at)
    return at(path, P.like(value) if isinstance(value, re.Pattern) else P.equal(value))


def _operators(ops: dict, path: str, at: Resolve) -> Column:
    out = F.lit(True)
    for op, v in ops.items():
        if op == "$options":
            continue
        out = out & _one(op, v, ops, path, at)
    return out


def _one(op: str, v: object, ops: dict, path: str, at: Resolve) -> Column:
    if op == "$eq":
        return _field(path, v, at) if isinstance(v, re.Pattern) else at(path, P.equal(v))
    if op == "$ne":
        return P.negated(at(path, P.like(v)) if isinstance(v, re.Pattern) else at(path, P.equal(v)))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return at(path, P.compared(op[1:], v))
    if op == "$in":
        return at(path, P.one_of(list(v)))
    if op == "$nin":
        return P.negated(at(path, P.one_of(list(v))))
    if op == "$not":
        return P.negated(_operators(v, path, at) if isinstance(v, dict) else _field(path, v, at))
    if op == "$exists":
        found = at(path, P.exists())
        return found if v else P.negated(found)
    if op == "$regex":
        return at(path, P.like(v, ops.get("$options", "")))
    if op == "$mod":
        return at(path, P.remainder(*v))
    if op == "$type":
        return at(path, P.of_type(v))
    if op == "$size":
        return at(path, P.size_of(v))
    if op == "$all":
        return at(path, P.every_of(list(v)))
    if op == "$elemMatch":
        return at(path, _element(v))
    if op in ("$and", "$or", "$nor"):
        parts = [_field(path, q, at) for q in v]
        some = _fold(parts, op == "$and")
        return P.negated(some) if op == "$nor" else some
    if op == "$where":
        if not callable(v):
            raise ExpressionError("$where takes a function of a column; texts of code are not run")
        return at(path, lambda col, kind: v(col) if col is not None else F.lit(False))
    raise ExpressionError(f'Unknown operator: "{op}"')


def _element(query: dict) -> Test:
    """An array of which one element satisfies all of ``query``."""

    def test(col: Column | None, kind: T.DataType) -> Column:
        if col is None or not isinstance(kind, T.ArrayType):
            return F.lit(False)
        inside = kind.elementType

        def of(e: Column) -> Column:
            return compiled(query, lambda path, t: matches(e, inside, path.split(".") if path else [], t))

        return F.exists(col, of)

    return test
