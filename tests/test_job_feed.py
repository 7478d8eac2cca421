"""Stored filter trees against a loop, pushed filters, pages and bounds of feed requests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import filters, job_feed

ROWS = [(i, None if i % 7 == 0 else i % 5, None if i % 6 == 0 else "aBc"[: i % 4], i % 3 == 0 if i % 4 else None, [] if i % 5 == 0 else [i % 3, i % 4], f"2024-01-{i % 28 + 1:02d} 00:00:00") for i in range(60)]
SCHEMA = "id long, n int, s string, b boolean, xs array<int>, at string"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("at", F.col("at").cast("timestamp")).cache()


def some_tree(r, depth):
    if depth and r.random() < 0.6:
        how = r.choice(["and", "or", "not"])
        return {"not": some_tree(r, depth - 1)} if how == "not" else {how: [some_tree(r, depth - 1) for _ in range(r.randrange(4))]}
    return r.choice([
        {"field": "n", "op": r.choice(["eq", "ne", "lt", "lte", "gt", "gte"]), "value": r.randrange(5)}, {"field": "n", "op": r.choice(["in", "not_in"]), "value": [1, 3][: r.randrange(3)]},
        {"field": "s", "op": "contains", "value": r.choice(["B", "c", ""])}, {"field": "s", "op": "null", "value": r.random() < 0.5}, {"field": "b", "value": r.random() < 0.5},
        {"field": "xs", "op": r.choice(["any", "all"]), "value": [0, 2][: r.randrange(1, 3)]}, {"field": "xs", "op": "has_or_empty", "value": 1},
    ])


def holds(tree, row):
    """True, False or None, as in SQL."""
    if "field" in tree:
        v, op, w = row[tree["field"]], tree.get("op", "eq"), tree["value"]
        if op == "null":
            return (v is None) == w
        if op == "in" and not w:
            return False
        if op == "not_in" and not w:
            return True
        if v is None:
            return None
        return {
            "eq": lambda: v == w, "ne": lambda: v != w, "lt": lambda: v < w, "lte": lambda: v <= w, "gt": lambda: v > w, "gte": lambda: v >= w, "in": lambda: v in w, "not_in": lambda: v not in w,
            "contains": lambda: w.lower() in v.lower(), "any": lambda: bool(set(v) & set(w)), "all": lambda: set(w) <= set(v), "has_or_empty": lambda: not v or w in v,
        }[op]()
    how, below = next(iter(tree.items()))
    if how == "not":
        inner = holds(below, row)
        return None if inner is None else not inner
    parts = [holds(b, row) for b in below]
    if how == "and":
        return False if False in parts else None if None in parts else True
    return True if True in parts else None if None in parts else False


def test_trees_by_a_loop(table):
    r = random.Random(3)
    for _ in range(25):
        tree = some_tree(r, 3)
        got = sorted(x.id for x in filters.apply_tree(table, json.dumps(tree)).select("id").collect())
        assert got == [row[0] for row in ROWS if holds(tree, dict(zip(("id", "n", "s", "b", "xs"), row))) is True], tree


@pytest.mark.parametrize("bad", [
    "{", "[]", {"field": "nope", "value": 1}, {"field": "n", "value": "1"}, {"field": "n", "value": True}, {"field": "s", "op": "like", "value": "x"}, {"and": {}}, {"field": "b", "value": 1},
    {"and": [], "or": []}, {"field": "xs", "value": 1}, {"field": "n", "op": "any", "value": [1]}, {"field": "at", "op": "gt", "value": "soon"}, {"field": "n", "op": "in", "value": 3}, {"field": "n", "value": 1, "x": 2},
])
def test_trees_that_do_not_fit(table, bad):
    with pytest.raises(filters.FilterError):
        filters.apply_tree(table, bad)


def test_conjuncts_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    tree = {"and": [{"field": "n", "op": "gte", "value": 2}, {"and": [{"field": "b", "value": True}, {"or": [{"field": "s", "value": "aB"}, {"field": "n", "value": 4}]}]}, {"not": {"field": "s", "op": "null", "value": True}}]}
    plan = filters.apply_tree(spark.read.parquet(path), tree).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")
    for part in ("GreaterThanOrEqual(n,2)", "EqualTo(b,true)", "Or(EqualTo(s,aB),EqualTo(n"):
        assert part in pushed[0]
    assert "xs" not in pushed[1]


def test_bounds_of_requests():
    assert job_feed.bounds({}) == (0, None)
    assert job_feed.bounds({"offset": "-4", "limit": "many"}) == (0, 0)
    assert job_feed.bounds({"offset": "12x", "limit": "7.9"}) == (12, 7)
    assert job_feed.bounds({"offset": "x", "limit": "-3"}) == (0, 0)


def test_visibility():
    assert job_feed.visibility({"verification_status": "Pending, REJECTED", "feed": "all"}) == {"field": "verification_status", "op": "in", "value": ["Pending", "REJECTED"]}
    assert job_feed.visibility({}) == job_feed.visibility({"feed": "ACTIVE"}) == {"field": "active_feed", "value": True}
    assert job_feed.visibility({"feed": "other"}) == {"and": []}
