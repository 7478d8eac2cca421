"""Counts, health, percentiles, windows and top-k reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.json import parsed
from ..operators import catalogue as c
from ..operators import identity, summaries
from .base import NOW, Tables, query

_NOW_SQL = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("counts_header", """
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_totalprice > 200000) AS large,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderdate >= DATE '1997-01-01') AS recent FROM orders
""")
def counts_header(t: Tables) -> DataFrame:
    want = {"total": F.lit(True), "open": F.col("o_orderstatus") == "O", "filled": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority") == "1-URGENT", "recent": F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")}
    return c.counts(t.orders, want)


@query("group_count_desc", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_count_desc(t: Tables) -> DataFrame:
    return summaries.counted(t.events, "event_type").orderBy(F.desc("n"), "event_type")


@query("group_count_two_keys", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_count_two_keys(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("duplicate_assertion", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_assertion(t: Tables) -> DataFrame:
    return summaries.counted(t.orders.where("o_orderstatus = 'O'"), "o_custkey").where("n > 1")


@query("queue_health", """
WITH s AS (SELECT CASE WHEN event_type LIKE 'p%' THEN 'p' WHEN event_type LIKE 'c%' THEN 'c' ELSE 'unknown' END AS src, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
g AS (SELECT src, count(*) AS total, count(*) FILTER (k < 30) AS pending, count(*) FILTER (k >= 30 AND k < 60) AS retry, count(*) FILTER (k >= 60) AS resolved FROM s GROUP BY src)
SELECT d.src, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending, coalesce(retry, 0) AS retry, coalesce(resolved, 0) AS resolved FROM (VALUES ('p'), ('c'), ('x')) d(src) LEFT JOIN g ON g.src = d.src
""")
def queue_health(t: Tables) -> DataFrame:
    source = F.when(F.col("event_type").startswith("p"), "p").when(F.col("event_type").startswith("c"), "c").otherwise("unknown")
    k = parsed(F.col("props"), "k int", "k")["k"]
    states = {"total": F.lit(True), "pending": F.col("k") < 30, "retry": F.col("k").between(30, 59), "resolved": F.col("k") >= 60}
    return summaries.zero_filled(c.counts(t.events.select(source.alias("src"), k.alias("k")), states, ["src"]), "src", ["p", "c", "x"])


@query("freshness_buckets", f"""
SELECT count(*) FILTER (ts >= {_NOW_SQL} - INTERVAL 24 HOUR) AS within_24h, count(*) FILTER (ts >= {_NOW_SQL} - INTERVAL 72 HOUR) AS within_72h, count(*) FILTER (ts < {_NOW_SQL} - INTERVAL 14 DAY) AS over_14d FROM events
""")
def freshness_buckets(t: Tables) -> DataFrame:
    return c.counts(t.events, summaries.age_buckets(F.col("ts"), now()))


@query("lag_percentiles", """
SELECT o_orderpriority, quantile_disc(lag, 0.5) AS p50, quantile_disc(lag, 0.95) AS p95 FROM (
  SELECT o_orderpriority, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS lag FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1
""")
def lag_percentiles(t: Tables) -> DataFrame:
    lag = F.greatest(F.lit(0), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).cast("long")
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", lag.alias("lag"))
    return rows.groupBy("o_orderpriority").agg(*summaries.nearest_rank("lag", 0.5, 0.95))


@query("median_value", "SELECT event_type, coalesce(median(value), 0) AS middle FROM events GROUP BY event_type")
def median_value(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("middle"))


@query("distinct_values", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def distinct_values(t: Tables) -> DataFrame:
    return t.events.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("latest_run_argmax", "SELECT event_type AS latest_run_id FROM events GROUP BY event_type ORDER BY max(ts) DESC, event_type LIMIT 1")
def latest_run_argmax(t: Tables) -> DataFrame:
    return c.latest_run(t.events.select(F.col("event_type").alias("run_id"), F.col("ts").alias("captured_at")))


@query("cursor_advance", "SELECT strftime(greatest(max(ts), TIMESTAMP '2000-01-01') - INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS cursor FROM events")
def cursor_advance(t: Tables) -> DataFrame:
    last = F.greatest(F.max("ts"), F.lit("2000-01-01").cast("timestamp_ntz"))
    return t.events.agg(F.date_format(last - F.expr("interval 15 minutes"), "yyyy-MM-dd HH:mm:ss").alias("cursor"))


@query("nearest_per_group", "SELECT s_nationkey, arg_min(s_suppkey, (abs(s_acctbal), s_suppkey)) AS s_suppkey FROM supplier GROUP BY s_nationkey")
def nearest_per_group(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct(F.abs("s_acctbal"), "s_suppkey")).alias("s_suppkey"))


@query("coverage_topk", """
SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) GROUP BY n_name ORDER BY n DESC, n_name LIMIT 8
""")
def coverage_topk(t: Tables) -> DataFrame:
    rich = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    bare = t.nation.join(rich, "n_nationkey", "left_anti")
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return c.overlay(bare, n, "n_nationkey", {"n": 0}).select("n_name", "n").orderBy(F.desc("n"), "n_name").limit(8)


@query("running_counters", "SELECT user_id, event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1, 2")
def running_counters(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("forward_fill", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations
""")
def forward_fill(t: Tables) -> DataFrame:
    out = summaries.forward_filled(t.conversations, ["conv_id"], ["turn", "role"], F.when(F.col("role") == "user", F.col("text")), "asked")
    return out.select("conv_id", "turn", "role", "asked")


@query("topk_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, rk FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rk FROM lineitem) WHERE rk <= 3
""")
def topk_per_group(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = identity.top(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 3, "rk")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "rk")


@query("rotating_sample", """
SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
WHERE place < 4 OR ((place - 4 - 5 * 6) % greatest(n - 4, 1) + greatest(n - 4, 1)) % greatest(n - 4, 1) < 6
""")
def rotating_sample(t: Tables) -> DataFrame:
    out = summaries.rotating_sample(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 4, 6, 5)
    return out.select("p_brand", "p_partkey")


@query("priority_fill", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS priority_rank FROM orders
ORDER BY priority_rank, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey LIMIT 200
""")
def priority_fill(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    due = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return summaries.priority_fill(t.orders, rank, [due.asc_nulls_first(), F.asc("o_orderkey")], 200).select("o_orderkey", "priority_rank")


@query("fingerprint", """
SELECT o_custkey, sha256('[' || string_agg('"' || CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus || '"', ',' ORDER BY o_orderkey) || ']') AS fingerprint, count(*) AS n FROM orders GROUP BY o_custkey
""")
def fingerprint(t: Tables) -> DataFrame:
    return summaries.fingerprint(t.orders, "o_custkey", "o_orderkey", F.concat_ws(":", "o_orderkey", "o_orderstatus"))


@query("ingest_metrics", """
SELECT source, count(*) AS discovered, count(*) FILTER (text = '') AS blank, count(*) FILTER (text <> '' AND n_chars < 200) AS short, count(*) FILTER (text <> '' AND n_chars >= 200) AS kept FROM documents GROUP BY source
""")
def ingest_metrics(t: Tables) -> DataFrame:
    has = F.col("text") != ""
    return c.counts(t.documents, {"discovered": F.lit(True), "blank": ~has, "short": has & (F.col("n_chars") < 200), "kept": has & (F.col("n_chars") >= 200)}, ["source"])


_PLACES = [("GERMANY", 51.2, 10.4), ("FRANCE", 46.2, 2.2), ("BRAZIL", -14.2, -51.9), ("JAPAN", 36.2, 138.3), ("CANADA", 56.1, -106.3)]


@query("haversine_bucket", f"""
WITH d(n_name, lat, lon) AS (VALUES {', '.join(map(str, _PLACES))}),
m AS (SELECT s_suppkey, floor(2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - 48.9) / 2), 2) + cos(radians(48.9)) * cos(radians(lat)) * pow(sin(radians(lon - 2.4) / 2), 2))) * 10 + 0.5) / 10 AS miles, s_acctbal < 0 AS remote
  FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN d ON d.n_name = nation.n_name)
SELECT s_suppkey, miles, CASE WHEN remote THEN 'local' WHEN miles IS NULL THEN 'unknown' WHEN miles <= 500 THEN 'local' ELSE 'outside' END AS bucket FROM m
""")
def haversine_bucket(t: Tables) -> DataFrame:
    dim = t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("n_name"), F.lit(a).alias("lat"), F.lit(b).alias("lon")) for n, a, b in _PLACES])))
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(dim), "n_name", "left")
    far = geo.rounded(geo.miles(F.lit(48.9), F.lit(2.4), F.col("lat"), F.col("lon")))
    return rows.select("s_suppkey", far.alias("miles"), geo.place(far, F.col("s_acctbal") < 0, 500).alias("bucket"))


@query("backoff", "SELECT event_id, CAST(least(120, 10 * pow(2, least(event_id % 9, 4))) AS INTEGER) AS minutes FROM events")
def backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", dates.retry_minutes(F.col("event_id") % 9).alias("minutes"))


@query("work_generation", """
SELECT n_nationkey, p_partkey FROM nation, (SELECT p_partkey FROM part) p
WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = n_nationkey AND l_partkey = p_partkey)
""")
def work_generation(t: Tables) -> DataFrame:
    """``work_generation`` over all parts."""
    done = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("n_nationkey"), F.col("l_partkey").alias("p_partkey"))
    return summaries.missing_work(t.nation.select("n_nationkey"), t.part.select("p_partkey"), done, ["n_nationkey", "p_partkey"])


@query("collated_top", """
WITH v AS (SELECT c_custkey, lower(c_mktsegment) AS base, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN base || 'e' WHEN 1 THEN upper(base[1]) || base[2:] || 'e' WHEN 2 THEN upper(base) || 'E' ELSE base || 'é' END AS name FROM v
ORDER BY base, k = 3, CASE WHEN k < 3 THEN k ELSE 0 END, c_custkey LIMIT 500
""")
def collated_top(t: Tables) -> DataFrame:
    """The first 500 names by Unicode collation: letters before accents before case."""
    base, k = F.lower("c_mktsegment"), F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(base, F.lit("e"))).when(k == 1, F.concat(F.initcap(base), F.lit("e"))).when(k == 2, F.concat(F.upper(base), F.lit("E"))).otherwise(F.concat(base, F.lit("é")))
    return t.customer.select("c_custkey", name.alias("name")).orderBy(F.collate("name", "UNICODE"), "c_custkey").limit(500)
