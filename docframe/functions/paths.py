"""Paths into nested data, compiled to columns when the query is built.

Two grammars. A *strict* path (``a.b[2].c``) must exist: an unknown field is a :class:`PathError` at once, a null on the way or an index
beyond the array fails when the query runs. A *predicate* path (``a.0.c``) never fails: arrays on the way match if any element
does, a number picks an element, and what is missing is undefined.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import PathError, QueryError

_BRACKET = re.compile(r"(.+?)\[(\d+)\]$")


def parse(path: str) -> list[tuple[str, int | None]]:
    """(key, index) of each segment; a segment has at most one index, and a lone ``[0]`` is a key."""
    out: list[tuple[str, int | None]] = []
    for segment in path.split(".") if path else []:
        m = _BRACKET.fullmatch(segment)
        out.append((m[1], int(m[2])) if m else (segment, None))
    return out


def child(col: Column, kind: T.DataType, key: str) -> tuple[Column, T.DataType] | None:
    """A struct's field or a map's value."""
    if isinstance(kind, T.StructType):
        return (col.getField(key), kind[key].dataType) if key in kind.names else None
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.try_element_at(col, F.lit(key)), kind.valueType
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(col, f"$[{key!r}]" if "'" not in key else f'$["{key}"]', "variant"), kind
    return None


def strict(root: Column, kind: T.DataType, path: str, *, nullable: bool = True) -> tuple[Column, T.DataType]:
    """The column at a strict path below ``root``, and its type.

    ``nullable`` says whether ``root`` itself may be null; fields of a row can't be on the way to nothing.
    """
    col, at = root, kind
    fails = lambda text: F.raise_error(F.lit(f'Path "{path}" does not exist: {text}'))
    for i, (key, index) in enumerate(parse(path)):
        found = child(col, at, key)
        if found is None:
            raise PathError(f'Path "{path}" does not exist: property "{key}" not found.')
        down, at = found
        if i or nullable:
            down = F.when(col.isNull(), fails(f'null/undefined at "{key}".')).otherwise(down)
        col = down
        if index is not None:
            if isinstance(at, T.VariantType):
                col = F.try_variant_get(col, f"$[{index}]", "variant")
                continue
            if not isinstance(at, T.ArrayType):
                raise PathError(f'Path "{path}" does not exist: "{key}" is not an array.')
            inside = F.get(col, F.lit(index))
            col = F.when(col.isNull(), fails(f'null/undefined at "{key}".')).when(F.size(col) <= index, fails(f"index {index} out of bounds.")).otherwise(inside)
            at = at.elementType
    return col, at


#: Builds a condition, true if it holds and else false or null, from a column and its type; the column is None for what the schema doesn't have.
Test = Callable[[Column | None, T.DataType], Column]


def matches(col: Column | None, kind: T.DataType, segments: list[str], test: Test) -> Column:
    """Whether ``test`` holds at a predicate path; for arrays, whether it holds for the array or any element."""
    if not segments or col is None:
        own = test(col, kind)
        if col is not None and isinstance(kind, T.ArrayType):
            return own | F.exists(col, lambda e: matches(e, kind.elementType, [], test))
        return own
    key, rest = segments[0], segments[1:]
    if isinstance(kind, T.ArrayType):
        inner = F.exists(col, lambda e: matches(e, kind.elementType, segments, test))
        if key.isdigit():
            return matches(F.get(col, F.lit(int(key))), kind.elementType, rest, test) | inner
        return inner
    found = child(col, kind, key)
    return matches(*found, rest, test) if found else matches(None, T.NullType(), rest, test)


def segments_of(path: str) -> list[str]:
    """Keys of a path without their indices."""
    return [re.sub(r"\[\d+\]$", "", s) for s in path.split(".")] if path else []


def get_path_segment_after(path: str, prefix: str) -> str:
    """The key right after the first place where all keys of ``prefix`` follow each other in ``path``."""
    own, lead = segments_of(path), segments_of(prefix)
    if not lead:
        raise QueryError("Prefix path is required.")
    for at in range(len(own) - len(lead)):
        if own[at : at + len(lead)] == lead:
            return own[at + len(lead)]
    raise QueryError(f'Prefix path "{prefix}" not found in "{path}".')


def path_segment_after(path: Column, prefix: str) -> Column:
    """:func:`get_path_segment_after` of a column of paths; null where the prefix isn't found."""
    lead = segments_of(prefix)
    if not lead:
        raise QueryError("Prefix path is required.")
    own = F.transform(F.split(path, r"\."), lambda s: F.regexp_replace(s, r"\[\d+\]$", ""))
    wanted = F.array(*[F.lit(x) for x in lead])
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own) - len(lead), F.lit(1))), lambda i: (F.slice(own, i, F.lit(len(lead))) == wanted) & (i + len(lead) <= F.size(own)))
    return F.get(own, F.get(places, F.lit(0)) + len(lead) - 1)


def occurrences(kind: T.DataType, name: str) -> list[str]:
    """Paths of fields called ``name`` anywhere below, parents first; ``[]`` stands for an array or map on the way."""
    out: list[str] = []

    def walk(at: T.DataType, path: str) -> None:
        if isinstance(at, T.StructType):
            if name in at.names:
                out.append(f"{path}{name}")
            for f in at.fields:
                walk(f.dataType, f"{path}{f.name}.")
        elif isinstance(at, T.ArrayType):
            walk(at.elementType, f"{path}[].")
        elif isinstance(at, T.MapType):
            walk(at.valueType, f"{path}[].")

    walk(kind, "")
    return out


def _has(kind: T.DataType, keys: list[str]) -> T.DataType | None:
    """The type at ``keys`` straight below, if the schema has it."""
    for key in keys:
        if not isinstance(kind, T.StructType) or key not in kind.names:
            return None
        kind = kind[key].dataType
    return kind


def found_types(kind: T.DataType, keys: list[str]) -> list[T.DataType]:
    """Types of all places where ``keys`` lead on from a node, parents first."""
    own = [t for t in [_has(kind, keys)] if t is not None]
    if isinstance(kind, T.StructType):
        return own + [t for f in kind.fields for t in found_types(f.dataType, keys)]
    if isinstance(kind, T.ArrayType):
        return own + found_types(kind.elementType, keys)
    if isinstance(kind, T.MapType):
        return own + found_types(kind.valueType, keys)
    return own


def deep_values(col: Column, kind: T.DataType, keys: list[str], to: str) -> Column:
    """array<to> of the values where ``keys`` lead on from any node, a node before what is below it; nulls are left out."""
    none = F.array().cast(f"array<{to}>")

    def cast(c: Column, at: T.DataType) -> Column:
        return F.to_json(c) if to == "string" and isinstance(at, (T.StructType, T.ArrayType, T.MapType)) else c.cast(to) if at.simpleString() != to else c

    def walk(c: Column, at: T.DataType) -> Column | None:
        parts: list[Column] = []
        here = _has(at, keys)
        if here is not None:
            value = c
            for key in keys:
                value = value.getField(key)
            parts.append(F.when(value.isNotNull(), F.array(cast(value, here))).otherwise(none))
        if isinstance(at, T.StructType):
            parts += [p for f in at.fields if (p := walk(c.getField(f.name), f.dataType)) is not None]
        elif isinstance(at, T.ArrayType) and found_types(at.elementType, keys):
            parts.append(F.coalesce(F.flatten(F.transform(c, lambda e: walk(e, at.elementType))), none))
        elif isinstance(at, T.MapType) and found_types(at.valueType, keys):
            parts.append(F.coalesce(F.flatten(F.transform(F.map_values(c), lambda e: walk(e, at.valueType))), none))
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else None

    out = walk(col, kind)
    return none if out is None else out
