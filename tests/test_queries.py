import importlib.util

import pytest

import __spark_entry__ as entry_module
from millrace.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, agrees):
    agrees(QUERIES[name], ORACLES[name])


def test_every_query_has_an_oracle():
    """SQL can't say what an order-dependent scan over two keys keeps; that query is tested below."""
    assert set(QUERIES) - set(ORACLES) == {"two_key_dedup"}


def test_two_key_dedup_by_brute_force(spark):
    rows = read_orders(spark)
    seen, want = set(), []
    for key, listing, identity in sorted(rows):
        if not {("l", listing), ("i", identity)} & seen:
            seen |= {("l", listing), ("i", identity)}
            want.append(key)
    assert sorted(r[0] for r in QUERIES["two_key_dedup"](spark, DATA).collect()) == want


def read_orders(spark):
    o = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus").collect()
    return [(r[0], r[1] % 700, f"{r[0] % 900}|{r[2]}") for r in o]


def test_entry(spark):
    found = entry_module.entry(spark)
    assert found.count() > 0
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_without_corpus_operators(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(entry_module, "find_spec", lambda m: None if "llm" in m or m == "corpus_pipeline" else real(m))
    assert set(entry_module.queries()) == set(QUERIES)
