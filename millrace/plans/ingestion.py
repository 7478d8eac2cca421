"""Ingestion of sightings into the catalogue, promotion of direct sightings, and the metrics of a run."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import identity, runs
from ..operators import ingest as ingestion
from ..operators.tables import Passing
from .base import Tables, query
from .identities import _CANON

#: Columns of the sightings and jobs that the queries derive from ``part``, in SQL that both engines read.
_SHARED = {
    "company": "p_brand",
    "source": "CASE WHEN p_size % 2 = 0 THEN 'greenhouse' ELSE 'lever' END",
    "source_job_id": "concat(p_brand, '-', CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size % 7 ELSE p_partkey % 1500 END AS STRING))",
    "requisition_id": "CASE WHEN p_partkey % 4 = 0 THEN concat('R', CAST(p_partkey % 97 AS STRING)) WHEN p_partkey % 4 = 1 THEN ' ' END",
    "title": "concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' Intern' ELSE '' END)",
    "location": "p_type",
    "official_url": "CASE WHEN p_partkey % 3 = 0 THEN concat('https://www.careers.example.com/jobs/', CAST(p_partkey % 211 AS STRING), '/?utm_source=', p_type) END",
    "source_url": "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 < 3 THEN concat('https://jobright.ai/jobs/', CAST(p_partkey % 301 AS STRING)) ELSE concat('https://boards.example.org/', CAST(p_partkey % 307 AS STRING)) END",
    "other_url": "CASE WHEN p_partkey % 11 = 0 THEN concat('http://careers.example.com/jobs/', CAST(p_partkey % 211 AS STRING)) END",
    "description": "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat(p_name, ' ', CAST(p_partkey % 17 AS STRING)) END",
    "posted_at": "CASE WHEN p_partkey % 8 > 0 THEN timestamp_seconds(1700000000 + p_partkey * 60) END",
    "confidence": "CASE p_size % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'DATE_ONLY' WHEN 2 THEN 'RELATIVE_PARSED' ELSE 'EXACT' END",
    "classification": "CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'QUALIFYING_INTERNSHIP' ELSE 'UNCERTAIN_CLASSIFICATION' END",
}


def _columns(duck: bool) -> str:
    made = ", ".join(f"{e} AS {c}" for c, e in _SHARED.items())
    return made.replace("timestamp_seconds(", "make_timestamp(1000000 * CAST(1 AS BIGINT) * (").replace("* 60)", "* 60))").replace("AS STRING", "AS VARCHAR") if duck else made


def _batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The jobs of an older run (a third of the parts, as they were) and every part as a sighting."""
    rows = t.part.selectExpr("p_partkey", *(f"{e} AS {c}" for c, e in _SHARED.items()))
    jobs = rows.where("p_partkey % 3 = 1").withColumnRenamed("p_partkey", "job_id")
    return jobs, rows.withColumnRenamed("p_partkey", "seq")


_JOB_STRUCT = (
    "{'job_id': CASE WHEN known THEN seq END, 'made_by': CASE WHEN known THEN NULL ELSE seq END, 'k1': k1, 'k2': k2, 'k4': k4, 'ko': CASE WHEN known OR ou IS NOT NULL THEN ko ELSE kd END, 'ks': ks, 'kx': kx,"
    " 'ou': CASE WHEN known OR ou IS NOT NULL THEN ou ELSE du END, 'su': su, 'd': d, 'pa': pa, 'rk': rk, 'cl': cl, 'last': CASE WHEN known THEN NULL ELSE seq END, 'n': CASE WHEN known THEN 0 ELSE 1 END}"
)
_FOLD = f"""
WITH RECURSIVE base AS (SELECT p_partkey, {_columns(True)} FROM part),
sightings_and_jobs AS (SELECT true AS known, p_partkey AS seq, * FROM base WHERE p_partkey % 3 = 1 UNION ALL SELECT false, p_partkey, * FROM base),
urls AS (
  SELECT known, seq, company, description AS d, posted_at AS pa, classification AS cl, nullif(trim(official_url), '') AS ou, nullif(trim(source_url), '') AS su, nullif(trim(other_url), '') AS xu,
    CASE WHEN source_url NOT LIKE 'https://jobright.ai/%' THEN source_url END AS du,
    CASE confidence WHEN 'EXACT' THEN 3 WHEN 'RELATIVE_PARSED' THEN 2 WHEN 'DATE_ONLY' THEN 1 ELSE 0 END AS rk,
    source || '|' || source_job_id AS k1, nullif(trim(requisition_id), '') AS k2,
    source || '|' || regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') || '|' || trim(regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g')) || '|' || coalesce(nullif(trim(requisition_id), ''), '-') AS k4 FROM sightings_and_jobs),
keyed AS (
  SELECT *, {_CANON.format(u='ou')} AS ko, {_CANON.format(u='su')} AS ks, {_CANON.format(u='xu')} AS kx, {_CANON.format(u='du')} AS kd FROM urls),
rows AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY known DESC, seq) AS nth, {_JOB_STRUCT} AS made FROM keyed),
fold AS (
  SELECT DISTINCT company, 0::BIGINT AS nth, [made][1:0] AS jobs, NULL::BIGINT AS seq, NULL::INT AS tier, NULL::BIGINT AS hit, NULL::VARCHAR AS outcome FROM rows QUALIFY row_number() OVER (PARTITION BY company) = 1
  UNION ALL
  SELECT company, nth, CASE WHEN hit IS NULL THEN list_append(jobs, made) ELSE list_transform(jobs, lambda j, i: CASE WHEN i <> hit THEN j ELSE
      {{'job_id': j.job_id, 'made_by': j.made_by, 'k1': j.k1, 'k2': j.k2, 'k4': j.k4, 'ko': nko, 'ks': CASE WHEN changed AND su IS NOT NULL THEN ks ELSE j.ks END, 'kx': j.kx,
        'ou': nou, 'su': CASE WHEN changed AND su IS NOT NULL THEN su ELSE j.su END, 'd': CASE WHEN changed AND d <> '' THEN d ELSE j.d END,
        'pa': CASE WHEN better THEN pa ELSE j.pa END, 'rk': CASE WHEN better THEN rk ELSE j.rk END, 'cl': coalesce(cl, j.cl), 'last': seq, 'n': j.n + 1}} END) END,
    CASE WHEN known THEN NULL ELSE seq END, CASE WHEN known THEN NULL ELSE tier END, CASE WHEN known THEN NULL ELSE coalesce(hit, len(jobs) + 1) END,
    CASE WHEN known THEN NULL WHEN hit IS NULL THEN 'new' WHEN changed THEN 'updated' ELSE 'unchanged' END
  FROM (SELECT *, d <> old.d OR su IS DISTINCT FROM old.su OR nou IS DISTINCT FROM old.ou AS changed, pa IS NOT NULL AND (old.pa IS NULL OR rk > old.rk) AS better
    FROM (SELECT *, coalesce(ou, old.ou, du) AS nou, CASE WHEN ou IS NOT NULL THEN ko WHEN old.ou IS NOT NULL THEN old.ko ELSE kd END AS nko
      FROM (SELECT *, jobs[hit] AS old FROM (SELECT *, CASE WHEN known THEN NULL ELSE coalesce(h1, h2, h3, h4) END AS hit,
          CASE WHEN h1 IS NOT NULL THEN 1 WHEN h2 IS NOT NULL THEN 2 WHEN h3 IS NOT NULL THEN 3 WHEN h4 IS NOT NULL THEN 4 END AS tier
        FROM (SELECT r.*, f.jobs, nullif(list_position(list_transform(f.jobs, lambda j: coalesce(j.k1 = r.k1, false)), true), 0) AS h1,
            nullif(list_position(list_transform(f.jobs, lambda j: coalesce(j.k2 = r.k2, false)), true), 0) AS h2,
            nullif(list_position(list_transform(f.jobs, lambda j: coalesce(list_contains([j.ko, j.ks, j.kx], coalesce(r.ko, r.ks)), false)), true), 0) AS h3,
            nullif(list_position(list_transform(f.jobs, lambda j: coalesce(j.k4 = r.k4, false)), true), 0) AS h4
          FROM fold f JOIN rows r ON r.company = f.company AND r.nth = f.nth + 1)))))),
final AS (SELECT company, arg_max(jobs, nth) AS jobs FROM fold GROUP BY company)
"""


@query("ingest_outcomes", _FOLD + """
SELECT o.seq, o.outcome, o.tier, f.jobs[o.hit].job_id AS job_id, f.jobs[o.hit].made_by AS made_by FROM fold o JOIN final f USING (company) WHERE o.seq IS NOT NULL
""")
def ingest_outcomes(t: Tables) -> DataFrame:
    """What became of each sighting of a batch."""
    jobs, sightings = _batch(t)
    return ingestion.ingest(jobs, sightings, "seq", Passing(t.spark, "ingest"))[0]


@query("ingest_jobs", _FOLD + """
SELECT company, j.job_id AS job_id, j.made_by AS made_by, j.ou AS official_url, j.su AS source_url, j.d AS description, j.pa AS posted_at, j.rk AS sureness, j.cl AS classification, j.last AS last_seq, CAST(j.n AS BIGINT) AS sightings
FROM (SELECT company, unnest(jobs) AS j FROM final)
""")
def ingest_jobs(t: Tables) -> DataFrame:
    """The jobs after a batch, with what their sightings changed."""
    jobs, sightings = _batch(t)
    after = ingestion.ingest(jobs, sightings, "seq", Passing(t.spark, "ingest"))[1]
    rank = F.when(F.col("confidence") == "EXACT", 3).when(F.col("confidence") == "RELATIVE_PARSED", 2).when(F.col("confidence") == "DATE_ONLY", 1).otherwise(0)
    return after.select("company", "job_id", "made_by", "official_url", "source_url", "description", "posted_at", rank.alias("sureness"), "classification", "last_seq", "sightings")


_FIVE = {
    "official_url": "CASE WHEN p_partkey % 3 = 0 THEN concat('https://www.careers.example.com/jobs/', CAST(p_partkey % 211 AS STRING), '/?utm_source=', p_type) END",
    "official_apply_url": "CASE WHEN p_partkey % 5 = 0 THEN concat('http://apply.example.com/', CAST(p_partkey % 101 AS STRING), '/') END",
    "official_job_url": "CASE WHEN p_partkey % 4 = 0 THEN concat('https://careers.example.com/jobs/', CAST(p_partkey % 97 AS STRING), '#apply') END",
    "source_url": "CASE WHEN p_partkey % 7 > 2 THEN concat('https://boards.example.org/', CAST(p_partkey % 307 AS STRING)) ELSE ' ' END",
    "url": "CASE WHEN p_partkey % 11 = 0 THEN concat('https://apply.example.com/', CAST(p_partkey % 89 AS STRING), '?ref=x&id=', CAST(p_partkey % 2 AS STRING)) END",
}
_APPLY = "CASE p_partkey % 3 WHEN 0 THEN concat('https://careers.example.com/jobs/', CAST(p_partkey % 239 AS STRING)) WHEN 1 THEN concat('https://apply.example.com/', CAST(p_partkey % 113 AS STRING), '?src=mail') ELSE concat('http://www.boards.example.org/', CAST(p_partkey % 331 AS STRING), '/') END"


def _duck(e: str) -> str:
    return e.replace("AS STRING", "AS VARCHAR")


_PROMOTED = f"""
WITH j AS (SELECT p_partkey AS job_id, p_brand AS company, {', '.join(f'{_duck(e)} AS {c}' for c, e in _FIVE.items())} FROM part),
u AS ({' UNION ALL '.join(f"SELECT job_id, company, {i} AS place, '{c}' AS name, {_CANON.format(u=c)} AS u FROM j" for i, c in enumerate(_FIVE))}),
s AS (SELECT p_partkey AS seq, p_brand AS company, {_duck(_APPLY)} AS apply_url FROM part),
k AS (SELECT seq, company, apply_url, {_CANON.format(u='apply_url')} AS u FROM s),
m AS (SELECT k.seq, k.apply_url, arg_min(u.job_id, (u.job_id, u.place)) AS match_id, arg_min(u.name, (u.job_id, u.place)) AS name FROM k JOIN u ON u.company = k.company AND u.u = k.u GROUP BY ALL)
"""


def _five(t: Tables) -> tuple[DataFrame, DataFrame]:
    jobs = t.part.selectExpr("p_partkey AS job_id", "p_brand AS company", "p_type AS source", "CAST(NULL AS STRING) AS requisition_id", *(f"{e} AS {c}" for c, e in _FIVE.items()))
    sightings = t.part.selectExpr(
        "p_partkey AS seq", "p_brand AS company", f"{_APPLY} AS apply_url", "CASE WHEN p_size % 2 = 0 THEN 'icims' ELSE 'lever' END AS ats_type", "lower(p_brand) AS ats_tenant",
        "CAST(p_partkey AS STRING) AS source_job_id", "CASE WHEN p_size % 3 = 0 THEN concat('R', CAST(p_size AS STRING)) END AS requisition_id",
    )
    return jobs, sightings


@query("any_url_match", _PROMOTED + "SELECT seq, match_id, name AS column FROM m")
def any_url_match(t: Tables) -> DataFrame:
    """The first job of the company with the sighting's URL in any of five columns."""
    jobs, sightings = _five(t)
    return identity.first_with_any_url(sightings, "seq", "company", F.col("apply_url"), jobs, "job_id", ingestion.URL_COLUMNS, keys.canonical_url)


@query("promote_direct", _PROMOTED + """,
w AS (SELECT match_id, max(seq) AS seq FROM m GROUP BY match_id)
SELECT j.job_id, CASE WHEN w.seq IS NULL THEN p.p_type WHEN s.p_size % 2 = 0 THEN 'icims' ELSE 'lever' END AS source, CASE WHEN w.seq IS NULL THEN j.official_url ELSE x.apply_url END AS official_url,
  CASE WHEN w.seq IS NULL THEN j.source_url ELSE x.apply_url END AS source_url, CASE WHEN s.p_size % 3 = 0 THEN 'R' || s.p_size END AS requisition_id,
  CASE WHEN w.seq IS NOT NULL THEN CASE WHEN s.p_size % 2 = 0 THEN 'icims-public-job-page' ELSE 'lever-board-api' END END AS verification_method, CASE WHEN w.seq IS NOT NULL THEN true END AS active_feed
FROM j JOIN part p ON p.p_partkey = j.job_id LEFT JOIN w ON w.match_id = j.job_id LEFT JOIN part s ON s.p_partkey = w.seq LEFT JOIN s x ON x.seq = w.seq
""")
def promote_direct(t: Tables) -> DataFrame:
    """Jobs with the provenance of the last direct sighting that names one of their URLs."""
    jobs, sightings = _five(t)
    out = ingestion.promote(jobs, sightings, F.lit("2024-01-01").cast("timestamp"))
    return out.select("job_id", "source", "official_url", "source_url", "requisition_id", "verification_method", "active_feed")


_TITLE = "CASE o_orderkey % 7 WHEN 1 THEN 'Software Engineer Intern' WHEN 2 THEN 'Senior Software Engineer' WHEN 3 THEN 'Summer Analyst' WHEN 4 THEN '' WHEN 5 THEN 'Robotics Co-op' ELSE 'Analyst' END"
_DESCRIPTION = "CASE WHEN o_orderkey % 9 = 0 THEN 'This position has been filled, position filled.' WHEN o_orderkey % 4 = 0 THEN 'For an undergraduate of the class of 2026' ELSE 'Work with us' END"
_LINK = "CASE WHEN o_orderkey % 19 = 0 THEN 'mailto:jobs@example.com' WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('http://boards.example.com/', CAST(o_custkey AS STRING), '/jobs/', CAST(o_orderkey % 23 AS STRING), '?utm_source=', o_orderstatus) END"
_ERROR = "CASE WHEN c_acctbal < 0 THEN 'fetch timeout' WHEN c_acctbal > 9500 THEN 'no such board' END"
_VENDOR = "CASE {c} % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END"


@query("ingest_run", f"""
WITH e AS (SELECT c_custkey, {_VENDOR.format(c='c_custkey')} AS source, {_ERROR} AS error FROM customer),
p AS (
  SELECT o_custkey * 4000000000 + o_orderkey AS seq, o_custkey, o_orderkey, o_orderstatus, source, {_TITLE} AS title, {_DESCRIPTION} AS description,
    CASE WHEN o_orderkey % 19 <> 0 AND o_orderkey % 17 <> 0 THEN o_custkey || '-' || (o_orderkey % 23) END AS link
  FROM orders JOIN e ON c_custkey = o_custkey WHERE error IS NULL),
b AS (
  SELECT *, CASE WHEN link IS NULL THEN 'missing_url' WHEN seq > min(seq) OVER (PARTITION BY link) THEN 'duplicate' WHEN title = '' THEN 'PARSE_FAILED' WHEN o_orderkey % 9 = 0 THEN 'CONFIRMED_CLOSED'
    WHEN o_orderkey % 7 IN (1, 5) THEN 'QUALIFYING_INTERNSHIP' WHEN o_orderkey % 7 = 3 AND o_orderkey % 4 = 0 THEN 'QUALIFYING_INTERNSHIP' WHEN o_orderkey % 7 = 3 THEN 'UNCERTAIN_CLASSIFICATION'
    WHEN o_orderkey % 7 = 2 THEN 'NOT_AN_INTERNSHIP' WHEN o_orderkey % 4 = 0 THEN 'UNCERTAIN_CLASSIFICATION' ELSE 'NOT_AN_INTERNSHIP' END AS bucket FROM p),
r AS (
  SELECT *, CASE WHEN bucket = 'QUALIFYING_INTERNSHIP' THEN CASE WHEN o_custkey % 2 = 1 OR o_orderkey % 23 % 3 > 0 THEN 'new' WHEN description = 'Work with us' AND o_orderstatus = 'O' THEN 'unchanged' ELSE 'updated' END END AS outcome,
    CASE bucket WHEN 'missing_url' THEN 'MISSING_OFFICIAL_URL' WHEN 'NOT_AN_INTERNSHIP' THEN 'EXCLUDED_NOT_AN_INTERNSHIP' WHEN 'UNCERTAIN_CLASSIFICATION' THEN 'REVIEW_UNCERTAIN'
      WHEN 'CONFIRMED_CLOSED' THEN 'EXCLUDED_CONFIRMED_CLOSED' WHEN 'PARSE_FAILED' THEN 'PARSE_FAILED' END AS reason FROM b),
s AS (SELECT source, count(*) AS discovered, count(*) FILTER (bucket = 'QUALIFYING_INTERNSHIP') AS qualifying, count(*) FILTER (outcome = 'new') AS inserted, count(*) FILTER (outcome = 'updated') AS updated FROM r GROUP BY source),
f AS (SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason UNION ALL
  SELECT CASE WHEN c_acctbal < 0 THEN 'BOARD_FETCH_TIMEOUT' ELSE 'BOARD_FETCH_PERSISTENCE_FAILED' END, count(*) FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9500 GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS employers_checked, (SELECT count(DISTINCT o_custkey) FROM p) AS employers_with_board, (SELECT count(*) FROM e WHERE error IS NOT NULL) AS employers_failed,
  count(*) AS rows_discovered, count(*) FILTER (bucket NOT IN ('missing_url', 'duplicate')) AS unique_rows, count(*) FILTER (bucket = 'QUALIFYING_INTERNSHIP') AS qualifying,
  count(*) FILTER (bucket = 'NOT_AN_INTERNSHIP') AS not_internship, count(*) FILTER (bucket = 'UNCERTAIN_CLASSIFICATION') AS uncertain, count(*) FILTER (bucket = 'CONFIRMED_CLOSED') AS closed,
  count(*) FILTER (bucket IN ('missing_url', 'PARSE_FAILED')) AS parse_failures, count(*) FILTER (outcome = 'new') AS inserted, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (bucket = 'duplicate') AS duplicates_prevented, count(*) FILTER (bucket = 'QUALIFYING_INTERNSHIP') AS official_urls_confirmed,
  (SELECT to_json(list({{'source': source, 'discovered': discovered, 'qualifying': qualifying, 'inserted': inserted, 'updated': updated}} ORDER BY source))::VARCHAR FROM s) AS by_source,
  (SELECT to_json(list({{'reason': reason, 'n': n}} ORDER BY reason))::VARCHAR FROM f) AS failures_by_reason FROM r
""")
def ingest_run(t: Tables) -> DataFrame:
    """A run over all customers' boards of orders: discovery, URL dedup, classification, ingestion, counters."""
    employers = t.customer.selectExpr("CAST(c_custkey AS STRING) AS employer", f"{_VENDOR.format(c='c_custkey')} AS source", "c_name AS tenant", f"{_ERROR} AS error")
    named = t.orders.selectExpr(
        "CAST(o_custkey AS STRING) AS employer", "o_custkey * 4000000000 + o_orderkey AS seq", "concat(o_custkey, '-', o_orderkey % 23) AS source_job_id", f"{_TITLE} AS title", f"{_DESCRIPTION} AS description",
        f"{_LINK} AS apply_url", "CAST(NULL AS STRING) AS employment_type", "CAST(o_orderkey % 23 AS STRING) AS location", "CAST(NULL AS TIMESTAMP) AS posted_at", "'UNKNOWN' AS confidence",
        "CAST(NULL AS STRING) AS requisition_id",
    )
    url = "concat('https://boards.example.com/', c_custkey, '/jobs/', k, '?utm_source=O')"
    known = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(22), F.lit(3))).alias("k"))
    jobs = known.selectExpr(
        "c_custkey * 100 + k AS job_id", f"{_VENDOR.format(c='c_custkey')} AS source", "concat(c_custkey, '-', k) AS source_job_id", "CAST(c_custkey AS STRING) AS company",
        "CAST(NULL AS STRING) AS requisition_id", "concat('known ', k) AS title", "CAST(k AS STRING) AS location", f"{url} AS official_url", f"{url} AS source_url", "CAST(NULL AS STRING) AS other_url",
        "'Work with us' AS description", "CAST(NULL AS TIMESTAMP) AS posted_at", "'UNKNOWN' AS confidence", "CAST(NULL AS STRING) AS classification",
    )
    passing = Passing(t.spark, "run")
    rows, _ = runs.ledger(employers, named, jobs, passing)
    return runs.metrics(employers, named, passing(rows))  # several aggregates read them
