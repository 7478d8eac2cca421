"""Closing notices anywhere in a page."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text

SHUT = [
    "This job is closed", "this\u00a0posting  has been expired", "The requisition has been cancelled.", "the requisition is canceled", "THE POSITION IS no longer available",
    "job posting has expired", "Job posting expired", "position has been filled", "job is no longer\navailable", "We're sorry, this job at Acme is no longer available", "we\u2019re sorry: the position you want is\tno longer available",
    "x" * 750_000 + " This job has been filled. " + "y" * 1000,
]
OPEN = ["we are no longer accepting faxes", "posting closed", "this job isclosed", "the job is closedown", "other position was filled", "We're sorry. The job. It is no longer available", "we're sorry " + "x" * 130 + " job no longer available", "", "the closed job"]


@pytest.mark.parametrize(("pages", "want"), [(SHUT, True), (OPEN, False), ([None], None)])
def test_closing_notices(spark, pages, want):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    assert [r.closed for r in rows.select("i", text.looks_closed(F.col("html")).alias("closed")).orderBy("i").collect()] == [want] * len(pages)
