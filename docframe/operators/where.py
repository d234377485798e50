"""One condition in the making: ``query.where(path).not_().equals(value)``."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from docframe.functions import predicates as P

from .base import Camel

if TYPE_CHECKING:
    from .items import Items


@dataclass(frozen=True, eq=False)
class Where(Camel):
    """Options come before the operator, which returns the query with the condition added."""

    parent: Items
    path: str
    negate: bool = False
    ignoring_case: bool = True
    trimming: bool = True

    def not_(self) -> Where:
        """Negates the condition; twice is once."""
        return replace(self, negate=True)

    def ignore_case(self) -> Where:
        return replace(self, ignoring_case=True)

    def case_sensitive(self) -> Where:
        return replace(self, ignoring_case=False)

    def trim(self) -> Where:
        """White space around the text that is looked for doesn't count; in the data it does."""
        return replace(self, trimming=True)

    def no_trim(self) -> Where:
        return replace(self, trimming=False)

    def _with(self, ignore_case: bool | None, trim: bool | None) -> Where:
        return replace(self, ignoring_case=self.ignoring_case if ignore_case is None else ignore_case, trimming=self.trimming if trim is None else trim)

    def _add(self, test: P.Test) -> Items:
        found = self.parent.at(self.path, test)
        return self.parent.filtered(P.negated(found) if self.negate else found)

    def _text(self, mode: str, value: str, ignore_case: bool | None, trim: bool | None) -> Items:
        own = self._with(ignore_case, trim)
        return own._add(P.text(mode, value, ignore_case=own.ignoring_case, trim=own.trimming))

    def equals(self, value: object, *, ignore_case: bool | None = None, trim: bool | None = None) -> Items:
        """Texts regardless of case unless told otherwise; a case-sensitive comparison doesn't trim."""
        own = self._with(ignore_case, trim)
        if isinstance(value, str) and own.ignoring_case:
            return own._text("exact", value, None, None)
        return own._add(P.equal(value))

    eq = equals

    def ne(self, value: object, *, ignore_case: bool | None = None, trim: bool | None = None) -> Items:
        return self.not_().equals(value, ignore_case=ignore_case, trim=trim)

    def contains(self, value: str, *, ignore_case: bool | None = None, trim: bool | None = None) -> Items:
        return self._text("contains", value, ignore_case, trim)

    def starts_with(self, value: str, *, ignore_case: bool | None = None, trim: bool | None = None) -> Items:
        return self._text("starts_with", value, ignore_case, trim)

    def ends_with(self, value: str, *, ignore_case: bool | None = None, trim: bool | None = None) -> Items:
        return self._text("ends_with", value, ignore_case, trim)

    def matches(self, pattern: str | re.Pattern, flags: str = "") -> Items:
        """A regular expression, with its own flags ``i``, ``m`` and ``s``."""
        return self._add(P.like(pattern, flags))

    def _compare(self, op: str, value: object) -> Items:
        # the opposite of an order is the other order: null and other types are in neither
        other = {"gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}
        return self.parent.filtered(self.parent.at(self.path, P.compared(other[op] if self.negate else op, value)))

    def greater_than(self, value: object) -> Items:
        return self._compare("gt", value)

    def greater_than_or_equal(self, value: object) -> Items:
        return self._compare("gte", value)

    def less_than(self, value: object) -> Items:
        return self._compare("lt", value)

    def less_than_or_equal(self, value: object) -> Items:
        return self._compare("lte", value)

    gt, gte, lt, lte = greater_than, greater_than_or_equal, less_than, less_than_or_equal
