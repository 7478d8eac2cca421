"""Work queues, lookups by containment, mail tracking, review and visibility policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import company_key
from .identity import latest
from .phrases import containing
from .tables import Passing

#: Ranks of application states; states outside always apply.
STATUS_RANK = {"SUBMITTED": 1, "ASSESSMENT_REQUIRED": 2, "INTERVIEW": 3, "OFFER": 4}
FINAL_STATUS = ("REJECTED", "CLOSED")
#: Verification states by stored status.
VERIFICATION = {
    "VERIFIED_OFFICIAL_AT_LAST_CHECK": "official_destination_verified", "ACTIVE_SOURCE_LISTED": "source_listed",
    "VERIFICATION_PENDING": "verification_pending", "Pending": "verification_pending", "NeedsReview": "verification_pending",
    "CLOSED_OR_UNVERIFIED": "verification_pending", "Closed": "destination_unavailable", "DESTINATION_MISMATCH": "destination_mismatch",
    "SecurityQuarantine": "quarantined",
}
#: Systems that a source's name may stand for, in order of preference.
SYSTEMS = ("greenhouse", "lever", "ashby", "smartrecruiters", "workday", "icims", "taleo", "successfactors", "usajobs", "manual")
#: What a source's name has besides the system's: a prefix, ends of sites, words.
SOURCE_PREFIX = "^ats:"
SITE_ENDS = r"\.(com|ai|io|co|net|org|jobs)\b"
SITE_WORDS = r"\b(ai|inc|llc|jobs|labs|the|app)\b"
#: Review reasons, in the order in which they are reported.
REVIEW_REASONS = (
    "EMPLOYER_NOT_APPROVED", "OFFICIAL_JOB_NOT_FOUND", "ATS_TENANT_NOT_PROVEN", "POSTING_CLOSED", "JOB_ID_MISMATCH", "COMPANY_MISMATCH",
    "LOCATION_MISMATCH", "NETWORK_FAILURE", "PARSING_FAILURE", "STALE_VERIFICATION", "DEMO_OR_FIXTURE", "MISSING_EVIDENCE",
)


#: The words by which a stored reason is known, and the order in which reasons count.
REASON_WORDS = {
    "DEMO_OR_FIXTURE": "fixture|mock test",
    "POSTING_CLOSED": "closed|no longer open|404",
    "LOCATION_MISMATCH": "location(?s:.*)(doesn.t match|mismatch)|(doesn.t match|mismatch)(?s:.*)location",
    "COMPANY_MISMATCH": "company(?s:.*)(doesn.t match|mismatch)|(doesn.t match|mismatch)(?s:.*)company",
    "JOB_ID_MISMATCH": "(job id|requisition)(?s:.*)mismatch|mismatch(?s:.*)(job id|requisition)",
    "NETWORK_FAILURE": "network|timed out|could not reach|fetch",
    "PARSING_FAILURE": "parse|malformed|invalid html",
    "OFFICIAL_JOB_NOT_FOUND": "could not independently locate|not found",
}
REASON_ORDER = (
    "DEMO_OR_FIXTURE", "POSTING_CLOSED", "UNAVAILABLE", "EMPLOYER_NOT_APPROVED", "LOCATION_MISMATCH", "COMPANY_MISMATCH", "JOB_ID_MISMATCH",
    "NETWORK_FAILURE", "PARSING_FAILURE", "STALE_VERIFICATION", "OFFICIAL_JOB_NOT_FOUND", "MISSING_EVIDENCE",
)


def company_lookup(names: DataFrame, name: str, companies: DataFrame, company: str, company_id: str, least: int = 5) -> DataFrame:
    """Each name with the least id of the companies of its key, else of those whose key contains it or is contained."""
    cut = Passing(names.sparkSession, "companies")
    n = cut(names.select(name).distinct().withColumn("_k", company_key(F.col(name))))
    c = cut(companies.groupBy(company_key(F.col(company)).alias("_c")).agg(F.min(company_id).alias("_id")).where("_c <> ''"))
    exact = n.join(c, F.col("_k") == F.col("_c")).select(name, F.lit(1).alias("_tier"), "_id")
    keyed = n.where(F.length("_k") >= least).select("_k").distinct()
    named = c.where(F.length("_c") >= least)
    longer = containing(keyed, "_k", "_k", named, "_c", cut)
    shorter = containing(named, "_c", "_c", keyed, "_k", cut)
    pairs = longer.unionByName(shorter).join(c, "_c").groupBy("_k").agg(F.min("_id").alias("_id"))
    part = n.join(pairs, "_k").select(name, F.lit(2).alias("_tier"), "_id")
    best = exact.unionByName(part).groupBy(name).agg(F.min(F.struct("_tier", "_id")).alias("_b"))
    return names.join(best.select(name, F.col("_b._id").alias("match_id")), name, "left")


def plain_words(c: Column) -> Column:
    """Lower-case letters and digits, all else as single blanks; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def mail_matches(mails: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each mail (mail_id, subject, from_address, body) with its job (job_id, title, company, requisition, employer_domain).

    A requisition of four signs or more in the mail comes first, then a sender's
    domain that ends like the employer's, then a company named in the mail that has
    a single job, or whose job's title is named too.  Within each of the three the
    least job_id wins, whatever the last one's method.  A requisition without
    letters or digits finds nothing.  ``mail_id`` must be unique.  Requisitions and
    companies are looked for in one pass.
    """
    cut = Passing(mails.sparkSession, "mails")
    texts = cut(mails.select("mail_id", plain_words(F.concat_ws(" ", "subject", "body")).alias("text")))
    plain = jobs.select("job_id", *(plain_words(F.col(c)).alias(c) for c in ("company", "title")), F.when(F.length("requisition") >= 4, plain_words(F.col("requisition"))).alias("requisition"))
    counted = cut(plain.join(plain.groupBy("company").agg(F.count("*").alias("n")), "company"))
    long = F.when(F.length("company") >= 3, F.col("company"))
    phrases = counted.select(F.explode(F.array("requisition", long)).alias("phrase"))
    held = cut(containing(texts, "mail_id", "text", phrases, "phrase", cut))
    by_id = held.join(counted.select("job_id", F.col("requisition").alias("phrase")), "phrase").select("mail_id", "job_id")
    sender = F.lower(F.nullif(F.regexp_extract("from_address", "@([A-Za-z0-9.-]+)", 1), F.lit("")))
    suffixes = F.transform(F.sequence(F.lit(1), F.length("domain")), lambda i: F.substring(F.col("domain"), i, F.length("domain")))
    employers = jobs.select("job_id", F.lower("employer_domain").alias("suffix"))
    by_domain = mails.select("mail_id", sender.alias("domain")).select("mail_id", F.explode(suffixes).alias("suffix")).join(employers, "suffix")
    met = held.join(counted.select("job_id", "n", "title", F.col("company").alias("phrase")), "phrase")
    unsure = met.where("n > 1 AND length(title) >= 3").join(texts, "mail_id").where("contains(text, title)")
    named = met.where("n = 1").select("mail_id", "job_id", "n").unionByName(unsure.select("mail_id", "job_id", "n"))
    tier = lambda df, k, method: df.select("mail_id", F.struct(F.lit(k).alias("tier"), "job_id", method.alias("method")).alias("found"))
    by_name = tier(named, 3, F.when(F.col("n") == 1, "company-name").otherwise("job-title"))
    every = tier(by_id, 1, F.lit("requisition-id")).unionByName(tier(by_domain, 2, F.lit("ats-domain"))).unionByName(by_name)
    best = every.groupBy("mail_id").agg(F.min("found").alias("b"))
    return mails.select("mail_id").join(best, "mail_id", "left").select("mail_id", "b.method", "b.job_id")


def progressed(events: DataFrame, by: Sequence[str], status: str, order: str) -> DataFrame:
    """Each owner's state after its events in order, which must be unique for an owner.

    A final state always applies and has no rank, so a ranked one that follows it
    applies again; of ranked states only a higher one does.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.col(status)], F.lit(0))
    ended = F.when(F.col(status).isin(*FINAL_STATUS), F.col(order))
    last = events.groupBy(*by).agg(F.max(ended).alias("_last"))
    since = events.join(last, list(by)).where(F.col("_last").isNull() | (F.col(order) >= F.col("_last")))
    reached = F.max_by(status, F.when(rank > 0, F.struct(rank, -F.col(order))))
    return since.groupBy(*by).agg(F.coalesce(reached, F.max_by(status, ended)).alias("status"))


def due(rows: DataFrame, state: str, next_at: str, now: Column) -> DataFrame:
    """Pending and retryable rows whose time has come; no time means now."""
    return rows.where(F.col(state).isin("pending", "retry") & (F.col(next_at).isNull() | (F.col(next_at) <= now)))


def recovered_leases(rows: DataFrame, state: str, locked_at: str, now: Column, seconds: int, attempts: str, most: int) -> DataFrame:
    """Running rows whose lease is over become retryable, or failed if their attempts are used up."""
    stale = (F.col(state) == "running") & (F.col(locked_at) < now - F.make_dt_interval(secs=F.lit(seconds)))
    return rows.withColumn(state, F.when(stale & (F.col(attempts) >= most), "failed").when(stale, "retryable").otherwise(F.col(state)))


def prunable(rows: DataFrame, state: str, at: str, now: Column, days: int, limit: int, key: str) -> DataFrame:
    """Keys of at most ``limit`` terminal rows older than ``days``, the oldest first (a bounded clean-up by design)."""
    old = rows.where(F.col(state).isin("resolved", "closed", "abandoned") & (F.col(at) < now - F.expr(f"interval {days} days")))
    return old.orderBy(at, key).limit(limit).select(key)


def stale_scores(scores: DataFrame, inputs: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """Scores made from other inputs than the present ones."""
    now = inputs.select(key, *[F.col(h).alias(f"_{h}") for h in hashes])
    changed = F.lit(False)
    for h in hashes:
        changed = changed | ~F.col(h).eqNullSafe(F.col(f"_{h}"))
    return scores.join(now, key).where(changed).select(*scores.columns)


def retired(registry: DataFrame, snapshot: DataFrame, key: str, source: str, ruled: Sequence[str]) -> DataFrame:
    """The registry with ``allowed`` false for rows of the ruled sources that the snapshot lacks."""
    kept = snapshot.select(key).distinct().withColumn("_in", F.lit(True))
    met = registry.join(kept, key, "left")
    return met.withColumn("allowed", F.coalesce("_in", ~F.col(source).isin(*ruled))).drop("_in")


def canonical_source(raw: Column, aggregators: Sequence[str] = ()) -> Column:
    """One token for a source's name, address or adapter label: an aggregator, a known system or ``other``."""
    low = F.regexp_replace(F.lower(F.trim(raw)), SOURCE_PREFIX, "")
    name = F.regexp_replace(F.when(low.rlike("^[a-z]+://"), F.regexp_extract(low, "^[a-z]+://([^/]+)", 1)).otherwise(low), r"^www\.", "")
    bare = F.regexp_replace(F.regexp_replace(name, SITE_ENDS, " "), "[^a-z0-9]+", " ")
    flat = F.regexp_replace(F.regexp_replace(bare, SITE_WORDS, " "), " ", "")
    found = F.when(low.isNull() | (low == ""), None)
    for s in (*aggregators, *SYSTEMS):
        found = found.when(flat.contains(s.replace("-", "")), s)
    return found.otherwise("other")


def verification_state(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in VERIFICATION.items() for x in kv])[status], F.lit("unverified"))


def in_active_feed(status: Column, source: Column, demo: Column, aggregators: Sequence[str] = ()) -> Column:
    """Whether a posting is shown by default: officially verified or manual, and from no aggregator."""
    state, kind = verification_state(status), canonical_source(source, aggregators)
    barred = demo | F.coalesce(kind.isin(*aggregators), F.lit(False)) if aggregators else demo
    return ~barred & ~state.isin("quarantined", "destination_unavailable", "destination_mismatch") & ((state == "official_destination_verified") | F.coalesce(kind == "manual", F.lit(False)))


def review_reason(demo: Column, closed: Column, approved: Column, reason: Column, verified_at: Column, now: Column, url: Column, evidence: Column, available: Column | None = None) -> Column:
    """The first reason why a posting needs review."""
    said = {name: F.coalesce(reason, F.lit("")).rlike(f"(?i){pattern}") for name, pattern in REASON_WORDS.items()}
    none = F.lit(False)
    facts = {
        "DEMO_OR_FIXTURE": demo, "POSTING_CLOSED": closed, "UNAVAILABLE": ~(F.lit(True) if available is None else available), "EMPLOYER_NOT_APPROVED": ~approved,
        "STALE_VERIFICATION": verified_at < now - F.expr("interval 24 hours"), "OFFICIAL_JOB_NOT_FOUND": url.isNull(), "MISSING_EVIDENCE": evidence.isNull(),
    }
    found = None
    for name in REASON_ORDER:
        holds = facts.get(name, none) | said.get(name, none)
        result = "MISSING_EVIDENCE" if name == "UNAVAILABLE" else name
        found = F.when(holds, result) if found is None else found.when(holds, result)
    return found.otherwise("ATS_TENANT_NOT_PROVEN")


def over_fetched(rows: DataFrame, order: Sequence[Column], keep: Column, limit: int, times: int = 3) -> DataFrame:
    """The first ``limit`` rows that pass a late test among the first ``limit * times`` (the test doesn't commute with the limit)."""
    return rows.orderBy(*order).limit(limit * times).where(keep).orderBy(*order).limit(limit)


def best_version(rows: DataFrame, by: Sequence[str], valid: Column, version: str) -> DataFrame:
    """The highest valid version of each group."""
    return latest(rows.where(valid), by, [F.desc(version)])
