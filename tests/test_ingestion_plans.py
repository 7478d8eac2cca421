"""The work by the row of an ingestion: spread over tasks, and each URL worked out once."""

import pytest
from pyspark.sql import functions as F
from test_ingestion import JOB_SCHEMA, fixture, some_rows

from millrace.functions import keys, text
from millrace.operators import ingest, runs
from millrace.operators.tables import Passing


@pytest.fixture
def first_written(spark):
    """A cut, and of the first table that it writes the plan and the number of tasks with rows."""
    passing, seen = Passing(spark, "plans"), []

    def cut(df):
        if not seen:
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
            seen.append(df.select(F.spark_partition_id()).distinct().count())
        return passing(df)

    return cut, seen


def test_urls_of_one_row_group_are_worked_out_once_by_many_tasks(spark, first_written):
    cut, seen = first_written
    jobs = spark.createDataFrame([(i, *r) for i, r in enumerate(some_rows(3, 60))], f"job_id long, {JOB_SCHEMA}").coalesce(1)
    sightings = spark.createDataFrame([(i, *r) for i, r in enumerate(some_rows(4, 120))], f"seq long, {JOB_SCHEMA}").coalesce(1)
    outcomes, _ = ingest.ingest(jobs, sightings, "seq", cut)
    assert outcomes.count() == 120
    plan, tasks = seen
    one = spark.range(1).select(keys.canonical_url(F.lit("u").substr(F.lit(1), F.col("id").cast("int"))))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("regexp_extract(") <= 3 * one.count("regexp_extract(") + 1  # three URLs of a row, and the host of one
    assert tasks == 4


def test_postings_of_one_row_group_are_classified_by_many_tasks(spark, first_written):
    cut, seen = first_written
    employers, postings, jobs = fixture(spark)
    rows, _ = runs.ledger(employers, postings.coalesce(1), jobs, cut, dry=True)
    assert rows.where("bucket = 'QUALIFYING_INTERNSHIP'").count() == 130
    assert seen[1] == 4


def test_the_first_of_a_shared_url_stays_whatever_its_class(spark):
    employers, postings, jobs = fixture(spark)
    url = F.when(F.col("seq") < 250, "http://www.boards.example.com/one/?utm_source=a").when(F.col("seq") < 255, " ").otherwise(F.col("apply_url"))
    rows, _ = runs.ledger(employers, postings.withColumn("apply_url", url).withColumn("seq", 1000 - F.col("seq")), jobs, Passing(spark, "test"))
    got = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert got == {"missing_url": 5, "duplicate": 249, "NOT_AN_INTERNSHIP": 3, "UNCERTAIN_CLASSIFICATION": 1, "PARSE_FAILED": 2}


def test_hosts_and_years(spark):
    urls = ["https://a.lever.co:443/x", "https://LEVER.co", "https://leverXco/", "https://lever.com", "https://www.lever.co/", "lever.co", "https://lever.co.uk", "", None]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select(
        "i", keys.host_in(F.col("u"), ["x.org", "lever.co"]).alias("a"), keys.host_in(F.col("u"), []).alias("b"), text.experience_years(F.col("u")).alias("c")
    )
    rows = sorted(got.collect())
    assert [r.a for r in rows] == [True, True, False, False, True, False, False, False, False]
    assert {(r.b, r.c) for r in rows} == {(False, None)}
    said = spark.createDataFrame([("12+ years of relevant experience",), ("no years of experience",)], "t string").select(text.experience_years(F.col("t")).alias("n"))
    assert [r.n for r in said.collect()] == [12, None]
