"""The feed of jobs that one user sees: visibility, filters, overlays, order, page and total in one query."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalogue
from .filters import apply_tree
from .identity import latest

OFFICIAL = "VERIFIED_OFFICIAL_AT_LAST_CHECK"
STATE = {"application_status": "DISCOVERED", "match_score": None, "eligibility_status": None, "saved": False, "hidden": False, "notes": None}


def whole_number(value: str | None) -> int | None:
    """The whole number that a text starts with."""
    found = re.match(r"\s*([+-]?\d+)", value or "")
    return int(found[1]) if found else None


def visibility(params: Mapping[str, str]) -> dict[str, Any]:
    """Which jobs a feed may show, as a filter tree: named verification states, else active, needs-review or all."""
    states = catalogue.parse_list(params.get("verification_status"))
    feed = (params.get("feed") or "active").lower()
    if states:
        return {"field": "verification_status", "op": "in", "value": states}
    if feed == "active":
        return {"field": "active_feed", "value": True}
    if feed in ("needsreview", "needs-review"):
        return {"and": [{"field": "active_feed", "value": False}, {"field": "verification_status", "op": "ne", "value": OFFICIAL}]}
    return {"and": []}


def feed_tree(params: Mapping[str, str]) -> dict[str, Any]:
    """The request's conditions on jobs as one filter tree."""
    parts: list[dict[str, Any]] = [visibility(params)]
    leaf = lambda field, op, value: parts.append({"field": field, "op": op, "value": value})
    for name in ("location", "internship_term", "duration"):
        if params.get(name):
            leaf(name, "contains", params[name])
    for name in ("workplace_type", "season", "sponsorship"):
        if params.get(name):
            leaf(name, "eq", params[name])
    for name in ("sophomore_eligible", "citizenship_or_clearance"):
        if params.get(name) in ("true", "false"):
            leaf(name, "eq", params[name] == "true")
    for name, field, op in (("posted_from", "posting_date", "gte"), ("posted_to", "posting_date", "lte"), ("verified_from", "last_verified_at", "gte"), ("verified_to", "last_verified_at", "lte")):
        if params.get(name):
            leaf(field, op, params[name])
    if params.get("comp_min"):
        leaf("comp_max_hourly", "gte", float(params["comp_min"]))
    if params.get("max_distance_miles"):
        near: list[dict[str, Any]] = [{"field": "distance_miles", "op": "lte", "value": float(params["max_distance_miles"])}]
        if params.get("include_remote") == "true":
            near.append({"field": "workplace_type", "value": "Remote"})
        parts.append({"or": near})
    tags = catalogue.parse_list(params.get("disciplines"))
    if tags:
        leaf("discipline_tags", "any", tags)
    if whole_number(params.get("graduation_year")) is not None:
        leaf("graduation_years", "has_or_empty", whole_number(params["graduation_year"]))
    return {"and": parts}


def job_feed(jobs: DataFrame, states: DataFrame, matches: DataFrame, user: Any, params: Mapping[str, str], stored: str | None = None) -> DataFrame:
    """The jobs that a user's request is about, with the user's state, score and run_row; not yet ordered.

    ``stored`` is a saved filter tree beside the request's own conditions.  States and
    matches are the user's alone; of several matches of a job the newest counts, and a
    job without one has its state's score.
    """
    rows = apply_tree(jobs, feed_tree(params))
    if stored is not None:
        rows = apply_tree(rows, stored)
    own = states.where(F.col("user_id") == F.lit(user)).drop("user_id")
    if params.get("status"):
        own = own.where(F.col("application_status") == params["status"])
    least = whole_number(params.get("match_score_min"))
    if least is not None:
        own = own.where(F.col("match_score") >= least)
    rows = rows.join(own, "id", "semi") if params.get("status") or least is not None else rows
    defaults = [F.coalesce(F.col(c), F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in STATE.items()]
    rows = rows.join(own.select("id", *STATE), "id", "left").select(*[rows[c] for c in rows.columns], *defaults)
    newest = latest(matches.where(F.col("user_id") == F.lit(user)), ["id"], [F.desc("created_at"), F.desc("score")]).select("id", F.col("score").alias("newest_score"))
    scored = rows.join(newest, "id", "left").withColumn("score", F.coalesce("newest_score", "match_score")).drop("newest_score")
    return catalogue.with_run_row(scored)


def bounds(params: Mapping[str, str]) -> tuple[int, int | None]:
    """Offset and limit of a request: no limit gives all, one that isn't a number an empty page."""
    offset = whole_number(params.get("offset")) or 0
    limit = params.get("limit")
    return max(offset, 0), None if not limit else max(0, whole_number(limit) or 0)


def feed_page(rows: DataFrame, params: Mapping[str, str]) -> DataFrame:
    """The request's page in order, each row with position (in the whole feed), total, offset and sort.

    The page is taken by a bounded top-k; the total is one aggregate of the same
    filters, joined as a row.
    """
    offset, limit = bounds(params)
    sort = catalogue.parse_sort((params.get("sort") or "").strip().lower())
    total = rows.agg(F.count("*").alias("total"))
    out = catalogue.page(rows, catalogue.feed_order(sort), offset, limit)
    return out.crossJoin(F.broadcast(total)).withColumns({"offset": F.lit(offset).cast("long"), "sort": F.lit(sort)})


def envelope(rows: DataFrame, params: Mapping[str, str], columns: list[str | Column], most: int = 1000) -> DataFrame:
    """One row: jobs (the page, as an array in order), total, offset, returned, sort; also for an empty page.

    The request's limit must be at most ``most``, as its rows become one value.
    """
    offset, limit = bounds(params)
    if limit is None or limit > most:
        raise ValueError(f"an envelope needs a limit of at most {most}")
    sort = catalogue.parse_sort((params.get("sort") or "").strip().lower())
    order = catalogue.feed_order(sort)
    numbered = catalogue.page(rows, order, offset, limit).select(F.monotonically_increasing_id().alias("n"), F.struct(*columns).alias("job"))
    listed = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "job"))), lambda x: x.job).alias("jobs"))
    one = listed.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    return one.select("jobs", "total", F.lit(offset).cast("long").alias("offset"), F.size("jobs").cast("long").alias("returned"), F.lit(sort).alias("sort"))
