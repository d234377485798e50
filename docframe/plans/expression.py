"""The small text language of filters: ``field operator value``, joined by `` and `` and `` or ``, read from left to right.

``a or b and c`` is ``(a or b) and c``: neither word binds tighter, and there are no parentheses.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column

from docframe.errors import ExpressionError
from docframe.functions import predicates as P

from .mongo import Resolve

_CLAUSE = re.compile(r"\s*([a-zA-Z_][a-zA-Z0-9_.]*)\s+(===|!==|==|!=|>=|<=|>|<|contains|startsWith|endsWith|not)\s+(.+)", re.S)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_BASED = re.compile(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+")


@dataclass(frozen=True)
class Clause:
    field: str
    operator: str
    value: object


def split(text: str) -> tuple[list[str], list[str]]:
    """(clauses, words between them); words inside quotes don't count, nor do those without a single space on either side."""
    parts, words, start, quote, i = [], [], 0, "", 0
    while i < len(text):
        c = text[i]
        if c in "'\"" and text[i - 1 : i] != "\\":
            quote = "" if quote == c else quote or c
        word = "" if quote else next((w for w in ("and", "or") if text[i : i + len(w) + 2].lower() == f" {w} "), "")
        if word:
            parts.append(text[start:i].strip())
            words.append(word)
            i += len(word) + 2
            start = i
        else:
            i += 1
    parts.append(text[start:].strip())
    return parts, words


def literal(text: str) -> object:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if _BASED.fullmatch(text):
        return int(text, 0)
    if _NUMBER.fullmatch(text):
        value = float(text)
        return int(value) if value == math.floor(value) and abs(value) < 2**53 else value
    if text in ("Infinity", "+Infinity", "-Infinity"):
        return float(text.replace("Infinity", "inf"))
    return {"true": True, "false": False, "null": None, "undefined": None}.get(text, text)


def parse_clause(text: str) -> Clause:
    m = _CLAUSE.fullmatch(text)
    if not m:
        raise ExpressionError(f'Invalid filter expression: "{text}". Expected format: "field operator value" (e.g., "status == \'Active\'")')
    return Clause(m[1], m[2].lower(), literal(m[3]))


def parse(text: str) -> tuple[list[Clause], list[str]]:
    parts, words = split(text)
    if not any(parts):
        raise ExpressionError(f'No valid expressions found in filter: "{text}"')
    if not all(parts):
        raise ExpressionError(f'A clause is missing beside "and" or "or" in filter: "{text}"')
    return [parse_clause(p) for p in parts], words


def condition(clause: Clause, at: Resolve, *, case_sensitive: bool = False, trim: bool = True, decimals: int | None = None) -> Column:
    field, op, value = clause.field, clause.operator, clause.value
    if op in ("==", "===", "!=", "!==", "not"):
        is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
        found = at(field, P.near(value, decimals) if decimals is not None and is_number else P.equal(value))
        return found if op in ("==", "===") else P.negated(found)
    if op in (">", ">=", "<", "<="):
        return at(field, P.compared({">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op], value))
    needle = {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else str(value)
    return at(field, P.text({"contains": "contains", "startswith": "starts_with", "endswith": "ends_with"}[op], needle, ignore_case=not case_sensitive, trim=trim))


def compiled(text: str, at: Resolve, **options) -> Column:
    """The condition of a whole expression."""
    clauses, words = parse(text)
    out = condition(clauses[0], at, **options)
    for word, clause in zip(words, clauses[1:], strict=True):
        more = condition(clause, at, **options)
        out = out & more if word == "and" else out | more
    return out
