"""Stored filter trees: JSON that is checked against a schema and compiled to one predicate."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalogue import contains_text

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
}
_LISTS = {"in", "not_in"}
_ARRAYS = {"any", "all", "has_or_empty"}
DEEPEST = 50


class FilterError(ValueError):
    """A stored filter that doesn't fit the table, with the place in its tree."""


def _value(value: Any, kind: T.DataType, at: str) -> Column:
    """A literal of the column's type; only values of that kind fit."""
    fits = {
        T.StringType: str, T.BooleanType: bool, T.TimestampType: str, T.TimestampNTZType: str, T.DateType: str,
    }.get(type(kind), (int, float) if isinstance(kind, T.NumericType) else None)
    if fits is None or not isinstance(value, fits) or isinstance(value, bool) and not isinstance(kind, T.BooleanType):
        raise FilterError(f"{at}: {value!r} doesn't fit {kind.simpleString()}")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        try:
            moment = datetime.datetime.fromisoformat(value)
        except ValueError:
            raise FilterError(f"{at}: {value!r} is not a date") from None
        return F.lit(moment.isoformat(sep=" ")).cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.lit(float(value))
    return F.lit(value) if isinstance(kind, (T.StringType, T.BooleanType)) or isinstance(value, float) else F.lit(value).cast(kind if abs(value) < 2**31 else "long")


def _leaf(node: dict[str, Any], schema: T.StructType, at: str) -> Column:
    name, op, value = node["field"], node.get("op", "eq"), node.get("value")
    if extra := set(node) - {"field", "op", "value"}:
        raise FilterError(f"{at}: unknown keys {sorted(extra)}")
    if not isinstance(name, str) or name not in schema.names:
        raise FilterError(f"{at}: no column {name!r}")
    kind, c = schema[name].dataType, F.col(f"`{name}`")
    if op == "null":
        if not isinstance(value, bool):
            raise FilterError(f"{at}: null takes true or false")
        return c.isNull() if value else c.isNotNull()
    if op in _ARRAYS:
        if not isinstance(kind, T.ArrayType):
            raise FilterError(f"{at}: {op} needs an array, {name} is {kind.simpleString()}")
        if op == "has_or_empty":
            return (F.size(F.coalesce(c, F.array().cast(kind))) == 0) | F.array_contains(c, _value(value, kind.elementType, at))
        if not isinstance(value, list) or not value:
            raise FilterError(f"{at}: {op} takes a list")
        wanted = F.array(*(_value(v, kind.elementType, at) for v in value))
        return F.arrays_overlap(c, wanted) if op == "any" else F.size(F.array_except(wanted, c)) == 0
    if op == "contains":
        if not isinstance(kind, T.StringType) or not isinstance(value, str):
            raise FilterError(f"{at}: contains takes a text in a text column")
        return contains_text(c, value)
    if op in _LISTS:
        if not isinstance(value, list):
            raise FilterError(f"{at}: {op} takes a list")
        found = c.isin([_value(v, kind, at) for v in value]) if value else F.lit(False)
        return found if op == "in" else ~found
    if op not in _COMPARE:
        raise FilterError(f"{at}: no operator {op!r}")
    return _COMPARE[op](c, _value(value, kind, at))


def _conjuncts(node: Any, schema: T.StructType, at: str, depth: int = 0) -> list[Column]:
    """The predicates that a node joins by and; nested ands are flattened."""
    if not isinstance(node, dict):
        raise FilterError(f"{at}: not an object")
    if depth > DEEPEST:
        raise FilterError(f"{at}: nested deeper than {DEEPEST}")
    if "field" in node:
        return [_leaf(node, schema, at)]
    if len(node) != 1 or next(iter(node)) not in ("and", "or", "not"):
        raise FilterError(f"{at}: an object has field, and, or, or not")
    how, below = next(iter(node.items()))
    if how == "not":
        return [~_all(_conjuncts(below, schema, f"{at}.not", depth + 1))]
    if not isinstance(below, list):
        raise FilterError(f"{at}: {how} takes a list")
    parts = [_conjuncts(b, schema, f"{at}.{how}[{i}]", depth + 1) for i, b in enumerate(below)]
    if how == "and":
        return [c for p in parts for c in p]
    return [reduce(lambda a, b: a | b, (_all(p) for p in parts), F.lit(False))]


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def compile_tree(stored: str | dict[str, Any], schema: T.StructType) -> list[Column]:
    """A stored filter's conjuncts over a table of this schema.

    A node is ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": ...}`` or a leaf
    ``{"field", "op", "value"}`` with the operators eq (if none is named), ne, lt, lte,
    gt, gte, in, not_in, contains (any case), null, and any, all, has_or_empty for
    arrays.  An empty and holds for all rows, an empty or for none; as in SQL, a null
    fails every comparison and its negation.  Anything else raises ``FilterError``
    before a row is read.
    """
    try:
        tree = json.loads(stored) if isinstance(stored, str) else stored
    except json.JSONDecodeError as e:
        raise FilterError(f"not JSON: {e}") from None
    return _conjuncts(tree, schema, "filter")


def apply_tree(rows: DataFrame, stored: str | dict[str, Any]) -> DataFrame:
    """The rows that a stored filter keeps; each conjunct is a filter of its own, so that scans take those that they can."""
    for c in compile_tree(stored, rows.schema):
        rows = rows.where(c)
    return rows
