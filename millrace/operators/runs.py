"""A run over employers' boards: which postings go where, what is ingested, and the run's counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import keys, text
from .ingest import dealt_out, ingest

#: Why a posting isn't ingested, by its classification.
EXCLUDED = {
    "NOT_AN_INTERNSHIP": "EXCLUDED_NOT_AN_INTERNSHIP", "UNCERTAIN_CLASSIFICATION": "REVIEW_UNCERTAIN",
    "CONFIRMED_CLOSED": "EXCLUDED_CONFIRMED_CLOSED", "PARSE_FAILED": "PARSE_FAILED",
}
QUALIFYING = "QUALIFYING_INTERNSHIP"


def error_code(message: Column, code: Column | None = None) -> Column:
    """A short label for an error, without its text."""
    by_text = (
        F.when(message.rlike("(?i)timeout|abort"), "TIMEOUT").when(message.rlike("(?i)unique constraint"), "UNIQUE_CONSTRAINT")
        .when(message.rlike("(?i)foreign key"), "FOREIGN_KEY").when(message.rlike("(?i)database|sqlite|locked"), "DATABASE_ERROR")
        .when(message.isNotNull(), "PERSISTENCE_FAILED").otherwise("UNKNOWN_ERROR")
    )
    return by_text if code is None else F.coalesce(F.nullif(code, F.lit("")), by_text)


def ledger(employers: DataFrame, postings: DataFrame, jobs: DataFrame, cut: Callable[[DataFrame], DataFrame], dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row for each posting of a run: source, bucket, reason, outcome; and the jobs after it.

    ``employers``: employer, source (the board's vendor), tenant, error (null if the
    board could be read).  ``postings``: seq (unique, the run's order), employer,
    source_job_id, title, description, employment_type, apply_url, location, posted_at,
    confidence, requisition_id.  Postings of boards that couldn't be read don't count.
    Buckets: missing_url, duplicate (an earlier posting of the run has the canonical
    URL), else the classification.  A dry run ingests nothing.
    """
    read = postings.join(employers.where("error IS NULL").select("employer", "source", "tenant"), "employer")
    spread = dealt_out(read, "seq")
    rows = spread.withColumn("official_url", keys.secure_url(F.trim("apply_url"))).withColumn("canonical", keys.canonical_url(F.col("official_url")))
    rows = cut(rows.withColumn("classified", text.classify_internship(F.col("title"), F.col("description"), F.col("employment_type"), F.lit(False))))
    first = rows.where("canonical IS NOT NULL").groupBy("canonical").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    bucket = F.when(F.col("canonical").isNull(), "missing_url").when(F.col("is_first").isNull(), "duplicate").otherwise(F.col("classified"))
    placed = cut(rows.join(first, "seq", "left").select("seq", "source", "tenant", bucket.alias("bucket")))
    reason = F.when(F.col("bucket") == "missing_url", "MISSING_OFFICIAL_URL")
    for classification, why in EXCLUDED.items():
        reason = reason.when(F.col("bucket") == classification, why)
    if dry:
        return placed.select("seq", "source", "bucket", reason.alias("reason"), F.lit(None).cast("string").alias("outcome")), jobs
    good = rows.join(placed.where(F.col("bucket") == QUALIFYING).select("seq"), "seq", "left_semi")
    sightings = good.select(
        "seq", "source", "source_job_id", F.col("employer").alias("company"), "requisition_id", "title", "location", "official_url", F.col("official_url").alias("source_url"),
        F.lit(None).cast("string").alias("other_url"), "description", "posted_at", "confidence", F.lit(QUALIFYING).alias("classification"),
    )
    outcomes, after = ingest(jobs, sightings, "seq", cut)
    out = placed.join(outcomes.select("seq", "outcome"), "seq", "left")
    return out.select("seq", "source", "bucket", reason.alias("reason"), "outcome"), after


def counters(bucket: Column, outcome: Column) -> dict[str, Column]:
    """The run's counters over its ledger; ``observe`` takes them as they are."""
    is_in = lambda *b: F.count_if(bucket.isin(*b))
    return {
        "rows_discovered": F.count(F.lit(1)), "unique_rows": F.count_if(~bucket.isin("missing_url", "duplicate")), "qualifying": is_in(QUALIFYING),
        "not_internship": is_in("NOT_AN_INTERNSHIP"), "uncertain": is_in("UNCERTAIN_CLASSIFICATION"), "closed": is_in("CONFIRMED_CLOSED"),
        "parse_failures": is_in("missing_url", "PARSE_FAILED"), "inserted": F.count_if(outcome == "new"), "updated": F.count_if(outcome == "updated"),
        "unchanged": F.count_if(outcome == "unchanged"), "duplicates_prevented": is_in("duplicate"), "official_urls_confirmed": is_in(QUALIFYING),
    }


def metrics(employers: DataFrame, postings: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: the counters, by_source and failures_by_reason of a run's ledger.

    One pass counts the ledger by (source, bucket, reason, outcome); everything else
    comes from that table, which has a row for each such combination.
    """
    cells = rows.groupBy("source", "bucket", "reason", "outcome").agg(F.count("*").alias("n"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    is_in = lambda *b: n(F.col("bucket").isin(*b))
    result = lambda o: n(F.coalesce(F.col("outcome") == o, F.lit(False)))
    totals = cells.agg(
        n(F.lit(True)).alias("rows_discovered"), n(~F.col("bucket").isin("missing_url", "duplicate")).alias("unique_rows"), is_in(QUALIFYING).alias("qualifying"),
        is_in("NOT_AN_INTERNSHIP").alias("not_internship"), is_in("UNCERTAIN_CLASSIFICATION").alias("uncertain"), is_in("CONFIRMED_CLOSED").alias("closed"),
        is_in("missing_url", "PARSE_FAILED").alias("parse_failures"), result("new").alias("inserted"), result("updated").alias("updated"), result("unchanged").alias("unchanged"),
        is_in("duplicate").alias("duplicates_prevented"), is_in(QUALIFYING).alias("official_urls_confirmed"),
    )
    by_source = cells.groupBy("source").agg(n(F.lit(True)).alias("discovered"), is_in(QUALIFYING).alias("qualifying"), result("new").alias("inserted"), result("updated").alias("updated"))
    sources = by_source.agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "discovered", "qualifying", "inserted", "updated")))).alias("by_source"))
    boards = employers.where("error IS NOT NULL").select(F.concat(F.lit("BOARD_FETCH_"), error_code(F.col("error"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    failures = cells.where("reason IS NOT NULL").groupBy("reason").agg(F.sum("n").alias("n")).unionByName(boards)
    reasons = failures.agg(F.to_json(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("failures_by_reason"))
    seen = employers.join(postings.select("employer").distinct().withColumn("posts", F.lit(True)), "employer", "left")
    boards_read = seen.agg(
        F.count("*").alias("employers_checked"), F.count_if(F.col("error").isNull() & F.col("posts").isNotNull()).alias("employers_with_board"), F.count_if(F.col("error").isNotNull()).alias("employers_failed"),
    )
    one = boards_read
    for more in (totals, sources, reasons):  # one row each
        one = one.crossJoin(F.broadcast(more))
    return one


def write_ledger(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes a run's ledger and returns its counters, counted by the same job."""
    seen = Observation("run")
    watched = rows.observe(seen, *(c.alias(name) for name, c in counters(F.col("bucket"), F.col("outcome")).items()))
    watched.write.parquet(path)
    return dict(seen.get)
