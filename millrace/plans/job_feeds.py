"""Whole feed requests: visibility, filters, stored trees, overlays, sort, page and total."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import job_feed
from .base import Tables, query

_JOBS = {
    "id": "o_orderkey",
    "location": "o_orderpriority",
    "internship_term": "concat('Summer ', CAST(1995 + o_orderkey % 5 AS STRING))",
    "duration": "CASE WHEN o_orderkey % 3 = 0 THEN '12 weeks' END",
    "posting_date": "o_orderdate",
    "posted_at": "CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END",
    "discovered_at": "CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate END",
    "last_verified_at": "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END",
    "captured_at": "o_orderdate",
    "run_id": "CASE WHEN o_orderkey % 6 > 0 THEN concat('run', CAST(o_orderkey % 4 AS STRING)) END",
    "row_index": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 50 END",
    "workplace_type": "CASE o_orderkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'On-site' END",
    "season": "CASE o_orderkey % 3 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Fall' END",
    "sponsorship": "CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'Unknown' END",
    "sophomore_eligible": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "citizenship_or_clearance": "o_orderkey % 7 = 0",
    "comp_max_hourly": "CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice / 10000 END",
    "distance_miles": "CASE WHEN o_orderkey % 8 > 0 THEN CAST(o_orderkey % 120 AS DOUBLE) END",
    "verification_status": "CASE o_orderkey % 5 WHEN 0 THEN 'VERIFIED_OFFICIAL_AT_LAST_CHECK' WHEN 1 THEN 'Pending' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'Pending' END",
    "active_feed": "o_orderkey % 3 > 0",
    "tags": "CASE o_orderkey % 4 WHEN 0 THEN '[\"Software\",\"Data\"]' WHEN 1 THEN '[\"Hardware\"]' WHEN 2 THEN '[]' END",
    "years": "CASE o_orderkey % 5 WHEN 0 THEN '[2026]' WHEN 1 THEN '[2027,2028]' WHEN 2 THEN '[]' END",
}
_STATES = {
    "id": "c_custkey * 3", "user_id": "c_nationkey % 3", "application_status": "CASE WHEN c_acctbal < 2000 THEN 'APPLIED' ELSE 'SAVED' END", "match_score": "CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 101 END",
    "eligibility_status": "CAST(NULL AS STRING)", "saved": "c_custkey % 2 = 0", "hidden": "c_custkey % 9 = 0", "notes": "c_name",
}
_MATCHES = {"id": "event_id % 700", "user_id": "user_id % 3", "score": "CAST(floor(value) AS INT)", "created_at": "ts"}
USER = 1

_DUCK = f"""
j AS (SELECT * REPLACE (CAST(tags AS VARCHAR) AS tags), CAST(coalesce(from_json(tags, '["VARCHAR"]'), []) AS VARCHAR[]) AS discipline_tags, CAST(coalesce(from_json(years, '["INT"]'), []) AS INT[]) AS graduation_years
  FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _JOBS.items()).replace('AS STRING', 'AS VARCHAR')} FROM orders)),
s AS (SELECT * FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _STATES.items()).replace('AS STRING', 'AS VARCHAR')} FROM customer) WHERE user_id = {USER}),
m AS (SELECT id, score AS newest FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, score DESC) AS n FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _MATCHES.items())} FROM events) WHERE user_id = {USER}) WHERE n = 1)
"""


def _request(where: str, states: str, order: str, offset: int, limit: str) -> str:
    """The SQL of a request: filtered, overlaid, numbered in order."""
    joined = f"JOIN (SELECT * FROM s WHERE {states}) s USING (id)" if states else "LEFT JOIN s USING (id)"
    return f"""WITH {_DUCK},
f AS (SELECT j.*, coalesce(s.application_status, 'DISCOVERED') AS application_status, coalesce(s.saved, false) AS saved, s.match_score, coalesce(m.newest, s.match_score) AS score FROM j {joined} LEFT JOIN m USING (id) WHERE {where}),
r AS (SELECT run_id FROM f WHERE captured_at IS NOT NULL AND run_id IS NOT NULL GROUP BY run_id ORDER BY max(captured_at) DESC, run_id LIMIT 1),
g AS (SELECT f.*, CASE WHEN f.run_id = (SELECT run_id FROM r) THEN row_index END AS run_row, count(*) OVER () AS total FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM g),
p AS (SELECT * FROM o WHERE position > {offset} AND position <= {offset} + {limit})
"""


_NEWEST = "posted_at DESC NULLS LAST, run_row NULLS LAST, discovered_at DESC NULLS LAST, id DESC"
_MATCH = "score DESC NULLS LAST, run_row NULLS LAST, discovered_at DESC NULLS LAST, id DESC"
_OLDEST = "posted_at NULLS LAST, run_row NULLS LAST, discovered_at NULLS LAST, id"


def _feed(t: Tables, params: dict[str, str], stored: str | None = None) -> DataFrame:
    jobs = t.orders.selectExpr(*(f"{e} AS {c}" for c, e in _JOBS.items()))
    parsed = lambda c, kind: F.coalesce(F.from_json(c, kind), F.array().cast(kind))
    jobs = jobs.withColumns({"discipline_tags": parsed("tags", "array<string>"), "graduation_years": parsed("years", "array<int>")})
    states = t.customer.selectExpr(*(f"{e} AS {c}" for c, e in _STATES.items()))
    matches = t.events.selectExpr(*(f"{e} AS {c}" for c, e in _MATCHES.items()))
    return job_feed.job_feed(jobs, states, matches, USER, params, stored)


_SHOWN = ["id", "application_status", "saved", "score", "posted_at", "run_row"]
NEWEST = {"location": "URGENT", "workplace_type": "Hybrid", "max_distance_miles": "90", "include_remote": "true", "comp_min": "5", "posted_from": "1993-01-01", "disciplines": "Hardware, Data", "offset": "3", "limit": "40"}


@query("job_feed_page", _request(
    "active_feed AND lower(location) LIKE '%urgent%' AND workplace_type = 'Hybrid' AND posting_date >= '1993-01-01' AND comp_max_hourly >= 5 AND (distance_miles <= 90 OR workplace_type = 'Remote') AND len(list_intersect(discipline_tags, ['Hardware', 'Data'])) > 0",
    "", _NEWEST, 3, "40") + "SELECT id, application_status, saved, score, posted_at, run_row, total, 3::BIGINT AS \"offset\", 'newest' AS sort FROM p")
def job_feed_page(t: Tables) -> DataFrame:
    """A page of the default feed under many conditions, with the total of all matching jobs."""
    return job_feed.feed_page(_feed(t, NEWEST), NEWEST).select(*_SHOWN, "total", "offset", "sort")


STORED = json.dumps({"or": [
    {"and": [{"field": "sponsorship", "value": "Yes"}, {"not": {"field": "season", "op": "in", "value": ["Summer", "Winter"]}}]},
    {"and": [{"field": "comp_max_hourly", "op": "gt", "value": 20}, {"or": [{"field": "sophomore_eligible", "value": True}, {"field": "duration", "op": "null", "value": False}]}]},
]})
STORED_SQL = "((sponsorship = 'Yes' AND NOT season IN ('Summer', 'Winter')) OR (comp_max_hourly > 20 AND (sophomore_eligible OR duration IS NOT NULL)))"
MATCHED = {"feed": "all", "match_score_min": "20", "status": "SAVED", "sort": "match", "limit": "25"}


@query("job_feed_envelope", _request(STORED_SQL, "application_status = 'SAVED' AND match_score >= 20", _MATCH, 0, "25") + """
SELECT (SELECT to_json(list({'id': id, 'score': score} ORDER BY position))::VARCHAR FROM p) AS jobs, (SELECT count(*) FROM f) AS total, 0::BIGINT AS "offset", (SELECT count(*) FROM p) AS returned, 'match' AS sort
""")
def job_feed_envelope(t: Tables) -> DataFrame:
    """A stored filter tree with the user's own conditions, by score, as one envelope."""
    one = job_feed.envelope(_feed(t, MATCHED, STORED), MATCHED, ["id", "score"])
    return one.withColumn("jobs", F.to_json("jobs"))


REVIEW = {"feed": "needs-review", "graduation_year": "2027", "sort": "oldest", "citizenship_or_clearance": "false"}


@query("job_feed_review", _request("NOT active_feed AND verification_status <> 'VERIFIED_OFFICIAL_AT_LAST_CHECK' AND NOT citizenship_or_clearance AND (len(graduation_years) = 0 OR list_contains(graduation_years, 2027))", "", _OLDEST, 0, "1000000000") + "SELECT id, application_status, saved, score, posted_at, run_row, position FROM p")
def job_feed_review(t: Tables) -> DataFrame:
    """The whole feed of jobs to review, oldest first; its positions come from an ordered scan, not one window."""
    from ..operators.scans import add_states, ordered_scan
    from ..operators.tables import Passing
    from ..operators.catalogue import feed_order

    rows = _feed(t, REVIEW).withColumn("all", F.lit(0))
    return ordered_scan(rows, "all", feed_order("oldest"), [], "position long", lambda: (1,), add_states, ["all", *_SHOWN], Passing(t.spark, "feed")).drop("all")
