"""Work queues, lookups, mail tracking, review and visibility over the tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import summaries, work
from .base import NOW, Tables, query

_NOW_SQL = f"TIMESTAMP '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("company_lookup", """
WITH n AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')) AS k FROM supplier), c AS (SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, 'Customer', 'Supplier'), '[^A-Za-z0-9]+', '', 'g')) AS k FROM customer),
m AS (SELECT s_suppkey, 1 AS tier, c_custkey AS id FROM n JOIN c USING (k) UNION ALL SELECT s_suppkey, 2, c_custkey FROM n JOIN c ON contains(n.k, c.k) OR contains(c.k, n.k) WHERE length(n.k) >= 5 AND length(c.k) >= 5)
SELECT n.s_suppkey, b.id AS match_id FROM n LEFT JOIN (SELECT s_suppkey, arg_min(id, (tier, id)) AS id FROM m GROUP BY 1) b USING (s_suppkey)
""")
def company_lookup(t: Tables) -> DataFrame:
    """``company_lookup`` among all customers."""
    c = t.customer.select("c_custkey", F.regexp_replace("c_name", "Customer", "Supplier").alias("name"))
    return work.company_lookup(t.supplier.select("s_suppkey", "s_name"), "s_name", c, "name", "c_custkey").select("s_suppkey", "match_id")


@query("mail_matches", r"""
WITH m AS (SELECT conv_id || '-' || turn AS mail_id, trim(regexp_replace(lower(role || ' ' || coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS text,
  lower(regexp_extract(CASE conv_id % 6 WHEN 0 THEN 'Ann <ann@Mail.Example.com>' WHEN 1 THEN 'hr@notexample.com' WHEN 2 THEN 'a.b@corp.net' WHEN 3 THEN 'nobody' END, '@([A-Za-z0-9.-]+)', 1)) AS domain FROM conversations),
w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
r AS (SELECT item_id AS job_id, w[3] || '-' || w[4] || '/' || w[5] AS requisition, CASE item_id WHEN 5 THEN 'example.com' WHEN 7 THEN 'Corp.net' END AS employer_domain, w[1] AS company, w[2] AS title FROM w),
j AS (SELECT job_id, length(requisition) AS signs, trim(regexp_replace(lower(requisition), '[^a-z0-9]+', ' ', 'g')) AS requisition, lower(employer_domain) AS employer_domain,
  trim(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', ' ', 'g')) AS company, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS title FROM r),
n AS (SELECT *, count(*) OVER (PARTITION BY company) AS n FROM j),
a AS (SELECT mail_id, job_id, n, CASE WHEN signs >= 4 AND requisition <> '' AND contains(m.text, requisition) THEN 1 WHEN suffix(domain, employer_domain) THEN 2
  WHEN length(company) >= 3 AND contains(m.text, company) AND (n = 1 OR (length(title) >= 3 AND contains(m.text, title))) THEN 3 END AS tier FROM m, n),
b AS (SELECT mail_id, arg_min(a, (tier, job_id)) AS a FROM a WHERE tier IS NOT NULL GROUP BY mail_id)
SELECT mail_id, CASE a.tier WHEN 1 THEN 'requisition-id' WHEN 2 THEN 'ats-domain' WHEN 3 THEN CASE WHEN a.n = 1 THEN 'company-name' ELSE 'job-title' END END AS method, a.job_id AS job_id FROM m LEFT JOIN b USING (mail_id)
""")
def mail_matches(t: Tables) -> DataFrame:
    """Every turn as a mail, every benchmark item as a job."""
    k = F.col("conv_id") % 6
    sender = F.when(k == 0, "Ann <ann@Mail.Example.com>").when(k == 1, "hr@notexample.com").when(k == 2, "a.b@corp.net").when(k == 3, "nobody")
    mails = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("mail_id"), F.col("role").alias("subject"), sender.alias("from_address"), F.col("text").alias("body"))
    w = lambda i: F.get(F.split("text", " "), F.lit(i))
    employer = F.when(F.col("item_id") == 5, "example.com").when(F.col("item_id") == 7, "Corp.net")
    requisition = F.concat(w(2), F.lit("-"), w(3), F.lit("/"), w(4))
    jobs = t.benchmark.select(F.col("item_id").alias("job_id"), w(1).alias("title"), w(0).alias("company"), requisition.alias("requisition"), employer.alias("employer_domain"))
    return work.mail_matches(mails, jobs)


@query("status_progress", """
WITH e AS (SELECT user_id, event_id, CASE event_id % 97 WHEN 0 THEN 'REJECTED' ELSE CASE event_type WHEN 'purchase' THEN 'OFFER' WHEN 'click' THEN 'INTERVIEW' WHEN 'view' THEN 'SUBMITTED' ELSE 'OTHER' END END AS status FROM events),
r AS (SELECT *, CASE status WHEN 'SUBMITTED' THEN 1 WHEN 'ASSESSMENT_REQUIRED' THEN 2 WHEN 'INTERVIEW' THEN 3 WHEN 'OFFER' THEN 4 ELSE 0 END AS rank FROM e),
l AS (SELECT user_id, max(event_id) FILTER (status = 'REJECTED') AS last FROM r GROUP BY user_id)
SELECT user_id, CASE max(rank) FILTER (last IS NULL OR event_id > last) WHEN 1 THEN 'SUBMITTED' WHEN 3 THEN 'INTERVIEW' WHEN 4 THEN 'OFFER' ELSE CASE WHEN count(last) > 0 THEN 'REJECTED' END END AS status
FROM r JOIN l USING (user_id) GROUP BY user_id
""")
def status_progress(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(F.col("event_id") % 97 == 0, "REJECTED").when(kind == "purchase", "OFFER").when(kind == "click", "INTERVIEW").when(kind == "view", "SUBMITTED").otherwise("OTHER")
    return work.progressed(t.events.select("user_id", "event_id", status.alias("status")), ["user_id"], "status", "event_id")


def _queue(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    state = F.when(k == 0, "pending").when(k == 1, "retry").when(k == 2, "running").when(k == 3, "resolved").otherwise("abandoned")
    return t.events.select("event_id", state.alias("state"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("at"), (F.col("event_id") % 4).alias("attempts"))


_QUEUE_SQL = "q AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'running' WHEN 3 THEN 'resolved' ELSE 'abandoned' END AS state, CASE WHEN event_id % 11 <> 0 THEN ts END AS seen_at, event_id % 4 AS attempts FROM events)"


@query("due_work", f"WITH {_QUEUE_SQL} SELECT event_id FROM q WHERE state IN ('pending', 'retry') AND (seen_at IS NULL OR seen_at <= {_NOW_SQL} - INTERVAL 100 DAY) ORDER BY seen_at DESC NULLS LAST, event_id LIMIT 200")
def due_work(t: Tables) -> DataFrame:
    rows = work.due(_queue(t), "state", "at", _now() - F.expr("interval 100 days"))
    return rows.orderBy(F.col("at").desc_nulls_last(), "event_id").limit(200).select("event_id")


@query("lease_recovery", f"WITH {_QUEUE_SQL} SELECT event_id, CASE WHEN state = 'running' AND seen_at < {_NOW_SQL} - INTERVAL 120 SECOND THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retryable' END ELSE state END AS state FROM q")
def lease_recovery(t: Tables) -> DataFrame:
    return work.recovered_leases(_queue(t), "state", "at", _now(), 120, "attempts", 3).select("event_id", "state")


@query("ttl_prune", f"WITH {_QUEUE_SQL}, d AS (SELECT event_id FROM q WHERE state IN ('resolved', 'closed', 'abandoned') AND seen_at < {_NOW_SQL} - INTERVAL 14 DAY ORDER BY seen_at, event_id LIMIT 1000) SELECT event_id FROM q WHERE event_id NOT IN (SELECT event_id FROM d)")
def ttl_prune(t: Tables) -> DataFrame:
    rows = _queue(t)
    return rows.join(work.prunable(rows, "state", "at", _now(), 14, 1000, "event_id"), "event_id", "left_anti").select("event_id")


@query("stale_scores", "SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0")
def stale_scores(t: Tables) -> DataFrame:
    made = t.orders.select("o_orderkey", F.sha2("o_orderpriority", 256).alias("profile"), F.lit("j").alias("posting"))
    now = t.orders.select("o_orderkey", F.sha2(F.when(F.col("o_custkey") % 3 == 0, "changed").otherwise(F.col("o_orderpriority")), 256).alias("profile"), F.lit("j").alias("posting"))
    return work.stale_scores(made, now, "o_orderkey", ["profile", "posting"]).select("o_orderkey")


@query("soft_delete", "SELECT s_suppkey, (s_suppkey % 4 = 0 OR s_nationkey % 2 = 1) AS allowed FROM supplier")
def soft_delete(t: Tables) -> DataFrame:
    registry = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 1, "manual").otherwise("csv").alias("source"))
    return work.retired(registry, t.supplier.where("s_suppkey % 4 = 0"), "s_suppkey", "source", ["csv", "seed", "discovered"]).select("s_suppkey", "allowed")


@query("active_feed", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'manual' WHEN 3 THEN 'bigfeed' ELSE 'other' END AS source,
  (p_partkey % 9 <> 0 AND p_partkey % 5 <> 3 AND p_partkey % 4 <> 2 AND (p_partkey % 4 = 0 OR p_partkey % 5 = 2)) AS active FROM part
""")
def active_feed(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.element_at(F.array(*map(F.lit, ["ats:Greenhouse", "https://jobs.lever.co/x", " Manual ", "www.Big-Feed.com", "?"])), (k % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ["VERIFIED_OFFICIAL_AT_LAST_CHECK", "Pending", "Closed", "unknown"])), (k % 4 + 1).cast("int"))
    return t.part.select("p_partkey", work.canonical_source(raw, ["bigfeed"]).alias("source"), work.in_active_feed(status, raw, k % 9 == 0, ["bigfeed"]).alias("active"))


@query("review_histogram", """
WITH r AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'DEMO_OR_FIXTURE' WHEN o_orderstatus = 'F' THEN 'POSTING_CLOSED' WHEN o_custkey % 2 = 0 THEN 'EMPLOYER_NOT_APPROVED' WHEN o_orderkey % 3 = 0 THEN 'NETWORK_FAILURE' WHEN o_orderkey % 3 = 1 THEN 'LOCATION_MISMATCH' ELSE 'STALE_VERIFICATION' END AS reason FROM orders),
n AS (SELECT reason, count(*) AS n FROM r GROUP BY reason)
SELECT d.reason, coalesce(n, 0) AS n FROM (VALUES ('DEMO_OR_FIXTURE'), ('POSTING_CLOSED'), ('EMPLOYER_NOT_APPROVED'), ('LOCATION_MISMATCH'), ('COMPANY_MISMATCH'), ('JOB_ID_MISMATCH'), ('NETWORK_FAILURE'), ('PARSING_FAILURE'), ('STALE_VERIFICATION'), ('OFFICIAL_JOB_NOT_FOUND'), ('MISSING_EVIDENCE'), ('ATS_TENANT_NOT_PROVEN')) d(reason) LEFT JOIN n ON n.reason = d.reason
""")
def review_histogram(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "Request timed out").when(k % 3 == 1, "The location doesn't match")
    reason = work.review_reason(k % 13 == 0, F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 != 0, said, F.col("o_orderdate"), _now() + F.expr("interval 1000 days"), F.lit("u"), F.lit("e"))
    return summaries.zero_filled(summaries.counted(t.orders.select(reason.alias("reason")), "reason"), "reason", work.REVIEW_REASONS)


@query("over_fetch", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 90) WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def over_fetch(t: Tables) -> DataFrame:
    return work.over_fetched(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], F.col("o_orderstatus") == "O", 30).select("o_orderkey")


@query("best_version", "SELECT l_orderkey, max(l_linenumber) AS version FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def best_version(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    out = work.best_version(rows, ["l_orderkey"], F.col("l_returnflag") != "R", "l_linenumber")
    return out.select("l_orderkey", F.col("l_linenumber").alias("version"))
