"""Catalogue feeds: filters, overlays, orders, pages, semi- and anti-joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue as c
from ..operators import identity, summaries
from .base import Tables, query

_FEED_SQL = """
WITH last AS (SELECT l_orderkey, l_quantity, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem),
p AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS posted_at, l_quantity AS score, l_shipdate AS discovered_at,
  o_orderpriority AS run_id, o_orderdate AS captured_at, o_custkey % 50 AS row_index FROM orders LEFT JOIN last ON o_orderkey = l_orderkey AND rn = 1),
r AS (SELECT run_id FROM p GROUP BY run_id ORDER BY max(captured_at) DESC, run_id LIMIT 1),
q AS (SELECT *, CASE WHEN run_id = (SELECT run_id FROM r) THEN row_index END AS run_row FROM p)
SELECT id, CAST(CAST(posted_at AS DATE) AS VARCHAR) AS posted, score, CAST(CAST(discovered_at AS DATE) AS VARCHAR) AS discovered, run_row
FROM q ORDER BY {order} LIMIT 100
"""
_SQL_ORDER = {
    "newest": "posted_at DESC NULLS LAST, run_row ASC NULLS LAST, discovered_at DESC NULLS LAST, id DESC",
    "oldest": "posted_at ASC NULLS LAST, run_row ASC NULLS LAST, discovered_at ASC NULLS LAST, id ASC",
    "match": "score DESC NULLS LAST, run_row ASC NULLS LAST, discovered_at DESC NULLS LAST, id DESC",
    "discovered": "discovered_at DESC NULLS LAST, run_row ASC NULLS LAST, discovered_at DESC NULLS LAST, id DESC",
}


def postings(t: Tables) -> DataFrame:
    """Orders as postings, each with its latest line as the newest match."""
    order = [F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    last = identity.latest(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"), ["l_orderkey"], order)
    o = t.orders
    return o.join(last, o["o_orderkey"] == last["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("posted_at"), F.col("l_quantity").alias("score"),
        F.col("l_shipdate").alias("discovered_at"), F.col("o_orderpriority").alias("run_id"), F.col("o_orderdate").alias("captured_at"), (F.col("o_custkey") % 50).alias("row_index"),
    )


def _feed(sort: str):
    @query(f"feed_{sort}", _FEED_SQL.format(order=_SQL_ORDER[sort]))
    def run(t: Tables) -> DataFrame:
        first = c.page(c.with_run_row(postings(t)), c.feed_order(sort), 0, 100)
        return first.select("id", F.to_date("posted_at").cast("string").alias("posted"), "score", F.to_date("discovered_at").cast("string").alias("discovered"), "run_row")

    return run


for _sort in c.SORTS:
    _feed(_sort)


@query("catalogue_query", """
SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted, o_totalprice AS price, o_orderpriority AS priority, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE lower(o_orderpriority) LIKE '%high%' AND o_totalprice >= 50000 AND o_totalprice <= 400000 AND o_orderstatus IN ('F', 'O')
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)
""")
def catalogue_query(t: Tables) -> DataFrame:
    want = {"priority": {"contains": "HIGH"}, "price": {"min": 50000, "max": 400000}, "status": ["F", "O"]}
    o = t.orders.where(c.compile_filter(want, {"priority": "o_orderpriority", "price": "o_totalprice", "status": "o_orderstatus"}))
    busy = t.lineitem.where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = o.join(busy, "o_orderkey", "left_semi").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("posted"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"))


@query("feed_filters", """
SELECT o_orderkey AS id FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND o_totalprice <= 200000 AND o_orderstatus NOT IN ('P') AND o_orderdate >= DATE '1995-01-01' AND o_custkey IS NOT NULL
""")
def feed_filters(t: Tables) -> DataFrame:
    spec = {"priority": {"contains": "urgent"}, "price": {"max": 200000}, "status": {"not": ["P"]}, "customer": {"null": False}}
    columns = {"priority": "o_orderpriority", "price": "o_totalprice", "status": "o_orderstatus", "customer": "o_custkey"}
    return t.orders.where(c.compile_filter(spec, columns) & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))).select(F.col("o_orderkey").alias("id"))


@query("array_filters", """
WITH d AS (SELECT doc_id, list_filter(['en', 'de', CASE WHEN n_chars > 2000 THEN 'long' END], lambda x: x IS NOT NULL AND (x = lang OR x = 'long')) AS tags FROM documents)
SELECT doc_id, list_has_any(tags, ['de', 'long']) AS overlaps, (len(tags) = 0 OR list_contains(tags, 'en')) AS has_or_empty FROM d
""")
def array_filters(t: Tables) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("lang") == "en", "en"), F.when(F.col("lang") == "de", "de"), F.when(F.col("n_chars") > 2000, "long")))
    d = t.documents.select("doc_id", tags.alias("tags"))
    names = {"tags": "tags"}
    return d.select("doc_id", c.compile_filter({"tags": {"any": ["de", "long"]}}, names).alias("overlaps"), c.compile_filter({"tags": {"has_or_empty": "en"}}, names).alias("has_or_empty"))


@query("distance_or_remote", "SELECT c_custkey FROM customer WHERE c_acctbal <= 1000 OR c_mktsegment = 'BUILDING'")
def distance_or_remote(t: Tables) -> DataFrame:
    return t.customer.where(c.distance_or(F.col("c_acctbal"), 1000, True, F.col("c_mktsegment") == "BUILDING")).select("c_custkey")


@query("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def page_offset(t: Tables) -> DataFrame:
    return c.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)


@query("page_number", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def page_number(t: Tables) -> DataFrame:
    return c.page_of(t.customer.select("c_custkey", "c_name"), [F.asc("c_name"), F.asc("c_custkey")], 3, 20)


@query("state_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def state_semi(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left_semi")


@query("state_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def state_anti(t: Tables) -> DataFrame:
    o = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left_anti")


@query("anti_in_or", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
  OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice < 1000 OR o_totalprice > 450000))
""")
def anti_in_or(t: Tables) -> DataFrame:
    """One aggregate and one join instead of two existence joins."""
    odd = F.max((F.col("o_totalprice") < 1000) | (F.col("o_totalprice") > 450000)).alias("odd")
    state = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(odd)
    return t.customer.select("c_custkey").join(state, "c_custkey", "left").where("odd IS NULL OR odd").select("c_custkey")


@query("overlay_defaults", """
WITH last AS (SELECT o_custkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, coalesce(o_orderstatus, 'none') AS status, coalesce(o_totalprice, 0.0) AS price FROM customer LEFT JOIN last ON o_custkey = c_custkey AND rn = 1
""")
def overlay_defaults(t: Tables) -> DataFrame:
    last = identity.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    state = last.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return c.overlay(t.customer.select("c_custkey"), state, "c_custkey", {"status": "none", "price": 0.0})


@query("nest_children", """
SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def nest_children(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    n = summaries.nested(t.orders.select("o_orderkey"), lines, "o_orderkey", "l_linenumber", ["l_partkey"])
    text = F.array_join(F.transform("children", lambda x: F.concat_ws(":", x.l_linenumber, x.l_partkey)), ",")
    return n.select("o_orderkey", F.size("children").cast("long").alias("n_lines"), text.alias("lines"))


@query("openings_per_owner", "SELECT c_custkey, count(o_orderkey) AS openings FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def openings_per_owner(t: Tables) -> DataFrame:
    n = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("openings"))
    return c.overlay(t.customer.select("c_custkey"), n, "c_custkey", {"openings": 0})


@query("owner_scope", "SELECT event_id FROM events WHERE user_id = 7 OR user_id IS NULL")
def owner_scope(t: Tables) -> DataFrame:
    return c.owned_by(t.events, 7, shared=True).select("event_id")


@query("allowlist_gate", "SELECT s_suppkey, CASE WHEN lower(trim(n_name)) IN ('germany', 'france', 'brazil') THEN 'admitted' ELSE 'review' END AS route FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def allowlist_gate(t: Tables) -> DataFrame:
    named = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    admitted = F.lower(F.trim("n_name")).isin("germany", "france", "brazil")
    return named.select("s_suppkey", F.when(admitted, "admitted").otherwise("review").alias("route"))


@query("union_of_feeds", "SELECT 'customer' AS feed, c_name AS name, c_mktsegment AS kind FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier")
def union_of_feeds(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("feed"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("feed"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("except_keys", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def except_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey").join(t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
