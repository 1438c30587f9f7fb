"""Metadata filters compiled to Columns: a missing or null value never yields NULL, so NOT works.

Three dialects: equality dicts, operator lists with AND / OR / NOT, and trees of
``{"operator", "field", "value"}`` and ``{"operator", "conditions"}``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import FilterError


def yes() -> Column:
    return F.lit(True)


def no() -> Column:
    return F.lit(False)


@dataclass(frozen=True)
class Fields:
    """How a filter finds a field: a column of the frame, or a key of a map column."""

    types: dict[str, T.DataType]
    map_column: str | None = None
    map_value: T.DataType | None = None

    @classmethod
    def of(cls, frame: DataFrame, map_column: str | None = None) -> "Fields":
        types = {f.name: f.dataType for f in frame.schema}
        value = types[map_column].valueType if map_column else None
        return cls(types, map_column, value)

    def get(self, name: str) -> tuple[Column, T.DataType] | None:
        name = name.removeprefix("meta.")
        if self.map_column:
            return F.element_at(F.col(self.map_column), F.lit(name)), self.map_value
        if name not in self.types:
            return None
        return F.col(f"`{name}`"), self.types[name]


def _kind(v: Any) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "other"


def _column_kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    return "string" if isinstance(t, T.StringType) else "other"


def _comparable(t: T.DataType, v: Any, op: str) -> None:
    if _column_kind(t) != _kind(v):
        raise FilterError(f"{op} can't compare {t.simpleString()} with {v!r}")


def _equal(c: Column, t: T.DataType, v: Any) -> Column:
    if v is None:
        return c.isNull()
    if isinstance(t, T.ArrayType):
        return F.coalesce(c == F.array(*map(F.lit, v)), no()) if isinstance(v, list) else no()
    # values of another kind are never equal (no cast)
    return F.coalesce(c == F.lit(v), no()) if _column_kind(t) == _kind(v) else no()


def _one_of(c: Column, t: T.DataType, values: list) -> Column:
    fit = [v for v in values if v is not None and _kind(v) == _column_kind(t)]
    return F.coalesce(c.isin(*fit), no()) if fit else no()


_COMPARE: dict[str, Callable[[Column, Any], Column]] = {">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "in", "nin", "contains", "text_match", "text_match_insensitive", "all", "any", "is_empty")


def condition(fields: Fields, name: str, op: str, value: Any = None) -> Column:
    """One operator on one field; see ``OPERATORS``."""
    got = fields.get(name)
    if got is None:  # a key no row has
        if op not in OPERATORS:
            raise FilterError(f"unknown operator {op}")
        return yes() if op in ("is_empty", "!=", "nin") else no()
    c, t = got
    array = isinstance(t, T.ArrayType)
    if op == "is_empty":
        empty = c.isNull()
        if array:
            return empty | F.coalesce(F.size(c) == 0, no())
        return empty | F.coalesce(c == "", no()) if isinstance(t, T.StringType) else empty
    if op == "==":
        return _equal(c, t, value) & c.isNotNull()
    if op == "!=":
        return ~_equal(c, t, value) | c.isNull()
    if op in _COMPARE:
        _comparable(t, value, op)
        return F.coalesce(_COMPARE[op](c, F.lit(value)), no())
    if op == "in":
        return _one_of(c, t, list(value))
    if op == "nin":
        return ~_one_of(c, t, list(value))
    if op == "contains":
        if array:
            return F.coalesce(F.array_contains(c, F.lit(value)), no())
        return F.coalesce(c.contains(str(value)), no()) if isinstance(t, T.StringType) else no()
    if op in ("text_match", "text_match_insensitive"):
        if not isinstance(t, T.StringType) or not isinstance(value, str):
            raise FilterError(f"{op} needs strings")
        hit = c.contains(value) if op == "text_match" else F.lower(c).contains(value.lower())
        return F.coalesce(hit, no())
    if op in ("all", "any"):
        want = F.array(*map(F.lit, value))
        if not array:
            return no()
        return F.coalesce(F.size(F.array_except(want, c)) == 0 if op == "all" else F.arrays_overlap(c, want), no())
    raise FilterError(f"unknown operator {op}")


@dataclass(frozen=True)
class Filter:
    key: str
    value: Any = None
    operator: str = "=="


@dataclass(frozen=True)
class Filters:
    """AND (default), OR or NOT over filters and groups; empty AND and OR hold, NOT holds where none does."""

    filters: list = field(default_factory=list)
    condition: str = "and"

    def compile(self, fields: Fields) -> Column:
        parts = [f.compile(fields) if isinstance(f, Filters) else condition(fields, f.key, f.operator, f.value) for f in self.filters]
        if self.condition not in ("and", "or", "not"):
            raise FilterError(f"unknown condition {self.condition}")
        if not parts:
            return yes()
        both = reduce(lambda a, b: a & b, parts) if self.condition == "and" else reduce(lambda a, b: a | b, parts)
        return ~both if self.condition == "not" else both


def matches(fields: Fields, wanted: dict[str, Any]) -> Column:
    """Every key must be there and equal (a wanted null needs the key of a map with a null value)."""
    out = yes()
    for k, v in wanted.items():
        got = fields.get(k)
        if got is None:
            return no()
        c, t = got
        hit = _equal(c, t, v)
        if fields.map_column:
            hit = hit & F.coalesce(F.map_contains_key(F.col(fields.map_column), F.lit(k)), no())
        out = out & hit
    return out


_TREE = {"==": "==", "!=": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<=", "in": "in", "not in": "nin"}


def tree(fields: Fields, node: dict[str, Any] | None) -> Column:
    """A filter tree; None or {} holds everywhere. ``== None`` is a missing value, and orderings of null never hold."""
    if not node:
        return yes()
    if "conditions" in node:
        parts = [tree(fields, x) for x in node["conditions"]]
        op = str(node.get("operator", "")).upper()
        if op not in ("AND", "OR", "NOT") or not parts:
            raise FilterError("a group needs AND, OR or NOT, and conditions")
        if op == "OR":
            return reduce(lambda a, b: a | b, parts)
        every = reduce(lambda a, b: a & b, parts)
        return ~every if op == "NOT" else every
    if not {"field", "operator", "value"} <= set(node):
        raise FilterError("a condition needs field, operator and value")
    op = node["operator"]
    if op not in _TREE:
        raise FilterError(f"unknown operator {op}")
    got, v = fields.get(node["field"]), node["value"]
    if op == "==":
        return (yes() if v is None else no()) if got is None else _equal(*got, v)
    if op == "!=":
        return (no() if v is None else yes()) if got is None else ~_equal(*got, v)
    if op in _COMPARE and v is None:
        return no()
    return condition(fields, node["field"], _TREE[op], v)
