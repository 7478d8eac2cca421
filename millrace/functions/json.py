"""Tolerant JSON and list parsing (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column, schema: str, required: str) -> Column:
    """A struct, or null where the text is malformed or lacks the required field."""
    got = F.from_json(text, schema)
    return F.when(got[required].isNotNull(), got)


def string_list(text: Column) -> Column:
    """A JSON array of strings, else a comma list, blanks dropped; null gives an empty list."""
    as_json = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    items = F.coalesce(as_json, F.split(text, ","), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
