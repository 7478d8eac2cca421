"""Keys, deduplication, identity resolution, fuzzy matching, merges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import identity, summaries
from ..operators.rounds import first_by_two_keys
from .base import Tables, query

_CANON = """
CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN
  'https://' || regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '')
  || CASE WHEN regexp_replace(regexp_extract({u}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({u}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') END
  || CASE WHEN len(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], '^(utm_[a-z]+|ref|source|src)$'))) > 0
     THEN '?' || array_to_string(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], '^(utm_[a-z]+|ref|source|src)$')), '&') ELSE '' END
ELSE nullif(trim({u}), '') END
"""


@query("url_canonical", f"SELECT page_id, {_CANON.format(u='url')} AS canonical FROM pages")
def url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", keys.canonical_url(F.col("url")).alias("canonical"))


@query("multi_col_antijoin", f"""
WITH p AS (SELECT page_id, url AS u, {_CANON.format(u='url')} AS k FROM pages),
n AS (SELECT CASE WHEN page_id % 3 = 0 THEN u END AS a, CASE WHEN page_id % 5 = 0 THEN u || '#x' END AS b, CASE WHEN page_id % 7 = 0 THEN replace(u, 'https://', 'http://www.') END AS c FROM p),
e AS (SELECT a AS u FROM n UNION ALL SELECT b FROM n UNION ALL SELECT c FROM n), f AS (SELECT {_CANON.format(u='u')} AS k FROM e WHERE u IS NOT NULL)
SELECT page_id FROM p WHERE k IS NULL OR k NOT IN (SELECT k FROM f WHERE k IS NOT NULL)
""")
def multi_col_antijoin(t: Tables) -> DataFrame:
    """Pages whose URL no page is known by in any of three columns, each with other pages and another spelling."""
    i = F.col("page_id")
    known = t.pages.select(
        F.when(i % 3 == 0, F.col("url")).alias("apply_url"), F.when(i % 5 == 0, F.concat("url", F.lit("#x"))).alias("listing_url"),
        F.when(i % 7 == 0, F.replace("url", F.lit("https://"), F.lit("http://www."))).alias("source_url"),
    )
    rows = t.pages.select("page_id", keys.canonical_url(F.col("url")).alias("k"))
    return identity.without_known_urls(rows, F.col("k"), known, ["apply_url", "listing_url", "source_url"], keys.canonical_url).select("page_id")


@query("tiered_identity", """
WITH n AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand || p_type ELSE 'x' END AS model, p_size AS size FROM part),
e AS (SELECT p_partkey AS id, p_name AS name, p_brand || p_type AS model, p_size AS size FROM part),
m AS (SELECT key, 1 AS tier, min(id) AS match_id FROM n JOIN e USING (name) GROUP BY key UNION ALL SELECT key, 2, min(id) FROM n JOIN e USING (model, size) GROUP BY key)
SELECT n.key, b.tier, b.match_id FROM n LEFT JOIN (SELECT key, min(tier) AS tier, arg_min(match_id, tier) AS match_id FROM m GROUP BY key) b ON b.key = n.key
""")
def tiered_identity(t: Tables) -> DataFrame:
    """With every part as incoming."""
    model = F.concat("p_brand", "p_type")
    new = t.part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, model).otherwise("x").alias("model"), F.col("p_size").alias("size"))
    old = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), model.alias("model"), F.col("p_size").alias("size"))
    return identity.tiered_identity(new, old, [["name"], ["model", "size?"]], "key", "id").select("key", "tier", "match_id")


@query("first_wins_dedup", "SELECT min(doc_id) AS doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS k FROM documents GROUP BY 2")
def first_wins_dedup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2(keys.title_key(F.col("text")), 256).alias("k"))
    return identity.first_wins(rows, "k", "doc_id")


@query("dup_counts", "SELECT count(*) AS total, count(DISTINCT md5(text)) AS kept, count(*) - count(DISTINCT md5(text)) AS duplicates FROM documents")
def dup_counts(t: Tables) -> DataFrame:
    return identity.duplicate_counts(t.documents.select(F.md5("text").alias("k")), "k")


@query("confidence_merge", """
SELECT user_id, arg_max(event_id, (rank, -event_id)) AS event_id, arg_max(event_type, (rank, -event_id)) AS event_type FROM (SELECT *, length(event_type) AS rank FROM events) GROUP BY user_id
""")
def confidence_merge(t: Tables) -> DataFrame:
    return identity.surest(t.events, ["user_id"], F.length("event_type"), ["event_id"], ["event_id", "event_type"])


@query("snapshot_diff", """
WITH o AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN o.p_size ELSE n.p_size END AS p_size, CASE WHEN n.p_partkey IS NULL THEN o.p_brand ELSE n.p_brand END AS p_brand,
  CASE WHEN o.p_partkey IS NULL THEN 'new' WHEN n.p_partkey IS NULL THEN 'absent' WHEN o.p_size IS DISTINCT FROM n.p_size OR o.p_brand IS DISTINCT FROM n.p_brand THEN 'updated' ELSE 'unchanged' END AS outcome
FROM o FULL JOIN n ON o.p_partkey = n.p_partkey
""")
def snapshot_diff(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_size", "p_brand")
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return identity.merged(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 2 = 0").withColumn("p_size", size), "p_partkey", ["p_size", "p_brand"])


@query("upsert_outcome", """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_acctbal < 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM customer) GROUP BY outcome
""")
def upsert_outcome(t: Tables) -> DataFrame:
    now = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    old = now.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.abs("c_acctbal"))
    return summaries.counted(identity.merged(old, now, "c_custkey", ["c_acctbal", "c_mktsegment"]), "outcome")


@query("insert_missing", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def insert_missing(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey")
    return identity.insert_missing(p.where("p_partkey % 3 = 0"), p.unionByName(p), ["p_partkey"])


_TOKENS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '\\b(202[0-9]|summer|spring|fall|winter)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2))"


@query("fuzzy_best_match", f"""
WITH p AS (SELECT p_partkey, p_brand, p_name, {_TOKENS_SQL.format(c='p_name')} AS w FROM part),
s AS (SELECT l.p_partkey AS l_key, r.p_partkey AS r_key, CASE WHEN l.p_name = r.p_name THEN 1.0 ELSE len(list_intersect(l.w, r.w)) / greatest(len(l.w), len(r.w)) END AS score FROM p l JOIN p r ON l.p_brand = r.p_brand AND l.p_partkey <> r.p_partkey)
SELECT l_key, r_key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_key ORDER BY score DESC, r_key) AS rn FROM s WHERE score >= 0.3) WHERE rn = 1
""")
def fuzzy_best_match(t: Tables) -> DataFrame:
    """Every part with the most similar other part of its brand."""
    name = F.col("p_name")
    out = identity.best_other(t.part, "p_brand", "p_name", "p_partkey", text.token_set(name), F.nullif(text.normalized(name), F.lit("")), text.token_similarity, 0.3)
    return out.select(F.col("p_partkey").alias("l_key"), F.col("other").alias("r_key"), F.round("score", 6).alias("score"))


_NAMES_SQL = "list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3))"


@query("name_jaccard", f"""
WITH a AS (SELECT p_partkey, {_NAMES_SQL.format(c='p_name')} AS x, {_NAMES_SQL.format(c='p_type')} AS y FROM part)
SELECT p_partkey, round(CASE WHEN len(x) + len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM a
""")
def name_jaccard(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(text.name_jaccard(F.col("p_name"), F.col("p_type")), 6).alias("jaccard"))


@query("identity_keys", """
SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS title_key, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS location_key, substring(sha256(c_name), 1, 40) AS event_key FROM customer
""")
def identity_keys(t: Tables) -> DataFrame:
    n = F.col("c_name")
    return t.customer.select("c_custkey", keys.title_key(n).alias("title_key"), keys.location_key(n).alias("location_key"), keys.event_key(n).alias("event_key"))


@query("two_key_dedup")
def two_key_dedup(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 700).alias("listing"), F.concat_ws("|", F.col("o_orderkey") % 900, "o_orderstatus").alias("identity"))
    return first_by_two_keys(rows, "o_orderkey", "listing", "identity").select("o_orderkey")
