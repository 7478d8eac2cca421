"""The catalogue query layer: composable filters, user overlays, feed orders and pages."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SORTS = ("newest", "oldest", "match", "discovered")


def parse_list(value: str | None) -> list[str]:
    """A comma list parameter, trimmed, without blanks."""
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def parse_sort(value: str | None) -> str:
    return value if value in SORTS else SORTS[0]


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive containment; the text is literal."""
    return F.lower(c).contains(text.lower())


def compile_filter(spec: dict[str, Any], columns: dict[str, str]) -> Column:
    """One predicate from a saved filter.

    ``columns`` maps field names to columns.  A field's value may be a scalar
    (equality), a list (membership), or a dict with any of ``min``, ``max``,
    ``contains``, ``not``, ``null`` (bool), ``any`` (array overlap) and
    ``has_or_empty`` (array holds the value, or is empty).
    """
    found = F.lit(True)
    for name, want in spec.items():
        c = F.col(columns[name])
        if isinstance(want, dict):
            for op, v in want.items():
                found = found & {
                    "min": lambda: c >= F.lit(v),
                    "max": lambda: c <= F.lit(v),
                    "contains": lambda: contains_text(c, v),
                    "not": lambda: ~c.isin(*v) if isinstance(v, list) else c != F.lit(v),
                    "null": lambda: c.isNull() if v else c.isNotNull(),
                    "any": lambda: F.arrays_overlap(F.coalesce(c, F.array()), F.array(*map(F.lit, v))),
                    "has_or_empty": lambda: (F.size(F.coalesce(c, F.array())) == 0) | F.array_contains(c, v),
                }[op]()
        elif isinstance(want, list):
            found = found & c.isin(*want)
        else:
            found = found & (c == F.lit(want))
    return found


def distance_or(distance: Column, most: float, flag: bool, remote: Column) -> Column:
    """Within the distance, or remote if remote work is wanted; unknown distances only by the latter."""
    near = F.coalesce(distance <= most, F.lit(False))
    return near | remote if flag else near


def overlay(rows: DataFrame, state: DataFrame, key: str, defaults: dict[str, Any]) -> DataFrame:
    """Left join of one user's state, with defaults where there is none."""
    chosen = state.select(key, *[F.col(c).alias(f"_{c}") for c in defaults])
    met = rows.join(chosen, key, "left")
    return met.select(*rows.columns, *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()])


def latest_run(rows: DataFrame) -> DataFrame:
    """One row: the run with the newest capture, by least run id on ties."""
    best = rows.where(F.col("captured_at").isNotNull() & F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max("captured_at").alias("at"))
    return best.orderBy(F.desc("at"), "run_id").limit(1).select(F.col("run_id").alias("latest_run_id"))


def feed_order(sort: str) -> list[Column]:
    """The order of a feed; nulls are last either way, and ids make it total.

    Needs posted_at, score, discovered_at, id and run_row (the row's place in the
    newest run, null for other runs).
    """
    up = sort == "oldest"
    first = {"match": "score", "discovered": "discovered_at"}.get(sort, "posted_at")
    way = (lambda c: F.col(c).asc_nulls_last()) if up else (lambda c: F.col(c).desc_nulls_last())
    return [way(first), F.col("run_row").asc_nulls_last(), way("discovered_at"), F.col("id").asc() if up else F.col("id").desc()]


def with_run_row(rows: DataFrame) -> DataFrame:
    """Adds run_row; the newest run is one row, so joining it is a broadcast of a row."""
    run = latest_run(rows)
    met = rows.join(F.broadcast(run), rows["run_id"] == run["latest_run_id"], "left")
    return met.withColumn("run_row", F.when(F.col("latest_run_id").isNotNull(), F.col("row_index"))).drop("latest_run_id")


def page(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of totally ordered rows; a negative offset counts as none."""
    out = rows.orderBy(*order)
    if offset > 0:
        out = out.offset(offset)
    return out if limit is None else out.limit(max(0, limit))


def page_of(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page by number (from 1), 10 to 100 rows."""
    size = min(100, max(10, size))
    return page(rows, order, (max(1, number) - 1) * size, size)


def owned_by(rows: DataFrame, user: Any, shared: bool = False, column: str = "user_id") -> DataFrame:
    """Only a user's own rows, and unowned ones if shared."""
    mine = F.col(column) == F.lit(user)
    return rows.where(mine | F.col(column).isNull() if shared else mine)


def counts(rows: DataFrame, predicates: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Any number of conditional counts in one pass."""
    aggs = [F.count_if(p).alias(n) for n, p in predicates.items()]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def relevant_facts(facts: DataFrame, order: str, posting: str, most: int = 40) -> DataFrame:
    """The facts (type, content, detail) to hold against a posting, with their scores, in their order.

    Facts that give context stay at any score, others with a score; beyond ``most``
    context comes first, then the higher score, then the earlier fact.
    """
    score = text.relevance(F.concat_ws(" ", "content", "detail"), text.match_tokens(F.lit(posting)))
    context = F.coalesce(F.col("type").isin(*text.CONTEXT_FACTS), F.lit(False))
    kept = facts.withColumn("score", score).where(context | (F.col("score") > 0))
    return kept.orderBy(context.desc(), F.desc("score"), order).limit(max(1, most)).orderBy(order)
