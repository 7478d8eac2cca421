from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, geo, json, keys, text
from millrace.operators import catalogue, identity, summaries
from millrace.sources import readers

NOW = datetime(2026, 8, 1, 12)


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_canonical_url(spark):
    urls = ["https://www.Acme.com/jobs/1/?utm_source=x&gh_src=y&gh_jid=7#top", "http://a.b/c?req=1&ref=z&postingId=2", "https://a.b/", "", None, " not a url ", "https://a.b/x?utm_medium=m"]
    assert column(spark, urls, keys.canonical_url) == ["https://acme.com/jobs/1?gh_jid=7", "https://a.b/c?req=1&postingId=2", "https://a.b/", None, None, "not a url", "https://a.b/x"]


def test_hosts_and_keys(spark):
    assert column(spark, ["https://jobs.lever.co/x", "https://notlever.co", None], lambda c: keys.host_in(c, ["lever.co"])) == [True, False, False]
    assert column(spark, ["New York, NY", "new york  ny ", None], keys.location_key) == ["new york ny", "new york ny", ""]
    assert column(spark, ["Software Engineer Intern!"], keys.title_key) == ["softwareengineerintern"]
    assert column(spark, ["Acme Robotics, Inc."], keys.company_key) == ["acmerobotics"]
    assert column(spark, ["Acme & Sons LLC"], keys.slug_candidates) == [["acmeandsons", "acme-and-sons"]]
    assert column(spark, ["", "a", "foobar"], keys.fnv1a32) == ["811c9dc5", "e40c292c", "bf9cf968"]


@pytest.mark.parametrize(
    ("title", "description", "kind", "closed", "want"),
    [
        ("Software Engineering Intern, Senior Platform Team", "", "", None, "QUALIFYING_INTERNSHIP"),
        ("Internal Audit Analyst", "", "", None, "NOT_AN_INTERNSHIP"),
        ("Summer Analyst", "Rising senior pursuing a bachelor degree", "", None, "QUALIFYING_INTERNSHIP"),
        ("Summer Analyst", "Join us", "", None, "UNCERTAIN_CLASSIFICATION"),
        ("  ", "", "", None, "PARSE_FAILED"),
        ("Intern", "", "", True, "CONFIRMED_CLOSED"),
        ("Engineer", "5+ years of experience", "", None, "NOT_AN_INTERNSHIP"),
        ("Engineer", "We love our interns", "", None, "UNCERTAIN_CLASSIFICATION"),
        ("Engineer", "", "Intern", None, "QUALIFYING_INTERNSHIP"),
        ("Engineer", "", "Full-time intern", None, "NOT_AN_INTERNSHIP"),
        (None, None, None, None, "PARSE_FAILED"),
    ],
)
def test_classifier(spark, title, description, kind, closed, want):
    row = spark.createDataFrame([(title, description, kind, closed)], "t string, d string, k string, c boolean")
    assert row.select(text.classify_internship(F.col("t"), F.col("d"), F.col("k"), F.col("c"))).first()[0] == want


def test_posting_dates(spark):
    raw = ["38 minutes ago", "3 months ago", "Posted Today", "yesterday", "1785585600", "1785585600000", "2026-07-30", "7/4/2026", "Jul 4, 2026", "2026-07-30T10:00:00Z", "soon", " ", None]
    got = column(spark, raw, lambda c: F.struct(F.date_format(dates.posted_at(c, F.lit(NOW))["posted_at"], "MM-dd HH:mm"), dates.posted_at(c, F.lit(NOW))["confidence"]))
    want = [("08-01 11:22", "RELATIVE_PARSED"), ("05-03 12:00", "RELATIVE_PARSED"), ("08-01 00:00", "DATE_ONLY"), ("07-31 00:00", "DATE_ONLY"), ("08-01 12:00", "EXACT"), ("08-01 12:00", "EXACT"), ("07-30 00:00", "DATE_ONLY"), ("07-04 00:00", "DATE_ONLY"), ("07-04 00:00", "DATE_ONLY"), ("07-30 10:00", "EXACT"), (None, "UNKNOWN"), (None, "UNKNOWN"), (None, "UNKNOWN")]
    assert [tuple(g) for g in got] == want


def test_ages_and_retries(spark):
    at = [datetime(2026, 8, 1, 11, 22), datetime(2026, 8, 1, 12, 5), datetime(2026, 7, 24, 12), datetime(2025, 1, 1), None]
    assert column(spark, at, lambda c: dates.age_label(c, F.lit(NOW)), "timestamp") == ["38 minutes ago", "just now", "1 week ago", "1 year ago", None]
    assert column(spark, [0, 1, 3, 9], dates.retry_minutes, "int") == [10, 20, 80, 120]


def test_fuzzy_match(spark):
    rows = spark.createDataFrame([("Software Intern 2026", "Clifton, NJ", "Software Intern", "Clifton, NJ", True), ("Software Intern", "Austin, TX", "Software Intern", "Clifton, NJ", True), ("Software Intern", None, "Software Intern", None, False)], "a string, l string, b string, m string, d boolean")
    got = [r[0] for r in rows.select(text.posting_match(*(F.col(c) for c in "albmd"))).collect()]
    assert got[0] == 1.0 and got[1:] == [0.0, 0.0]


def test_text_rules(spark):
    mails = ["Please email your cv to recruiter123@gmail.com now", "email hr@acme.com", "pay an application fee in bitcoin"]
    assert column(spark, mails, text.fraud_signals) == [["personal-email-contact"], [], ["requests-payment", "requests-cryptocurrency"]]
    assert column(spark, ["AB_C: DEF: hello", "ABC: DEF: GHI"], text.strip_repeated_prefixes) == ["hello", "ABC: DEF: GHI"]
    assert column(spark, ["<p>a&amp;b</p><script>x</script> <b>c</b>"], text.html_text) == ["a&b c"]
    assert column(spark, ['["a", " b"]', "x, y", None], json.string_list) == [["a", "b"], ["x", "y"], []]
    assert column(spark, ["Clifton, NJ 07011", "Remote"], geo.city_key) == ["clifton, nj", None]


def test_feed_order_is_total_and_stable(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else datetime(2026, 7, 1 + i % 9), i % 3, datetime(2026, 7, 2), "r1" if i % 2 else "r2", datetime(2026, 7, 3 + i % 2), i) for i in range(40)], "id long, posted_at timestamp, score int, discovered_at timestamp, run_id string, captured_at timestamp, row_index int")
    for sort in catalogue.SORTS:
        order = catalogue.feed_order(sort)
        a = [r.id for r in catalogue.page(catalogue.with_run_row(rows), order).collect()]
        b = [r.id for r in catalogue.page(catalogue.with_run_row(rows.orderBy(F.desc("id"))), order).collect()]
        assert a == b
        if sort in ("newest", "oldest"):
            assert {i % 5 for i in a[-8:]} == {0}
        assert [r.id for r in catalogue.page(catalogue.with_run_row(rows), order, 5, 10).collect()] == a[5:15]


def test_operators(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 2), (3, None, 1), (4, None, 9)], "id int, k string, v int")
    assert sorted(r.id for r in identity.first_wins(rows, "k", "id").collect()) == [1, 3, 4]
    assert identity.duplicate_counts(rows, "k").first().asDict() == {"total": 4, "kept": 3, "duplicates": 1}
    empty = rows.where("false")
    assert identity.first_wins(empty, "k", "id").count() == 0
    assert identity.duplicate_counts(empty, "k").first().asDict() == {"total": 0, "kept": 0, "duplicates": 0}
    assert summaries.zero_filled(summaries.counted(rows, "k"), "k", ["a", "z"]).orderBy("k").collect() == [("a", 2), ("z", 0)]


def test_csv_employers(spark, tmp_path):
    lines = ["employer,sector", '"Acme, Inc.",Robots', '" acme, inc. ",Other', ",None", '"Say ""hi""","two', 'lines"', ""]
    (tmp_path / "e.csv").write_bytes("\r\n".join(lines).encode())
    rows = readers.csv_rows(spark, str(tmp_path / "e.csv"))
    got = {(r.employer, r.status) for r in readers.approved_employers(rows, "employer", ["employer", "sector"]).collect()}
    assert got == {("Acme, Inc.", "kept"), ("acme, inc.", "duplicate"), (None, "rejected"), ('Say "hi"', "kept")}
    with pytest.raises(ValueError):
        readers.approved_employers(rows, "employer", ["website"])


def test_boards_and_feeds(spark):
    pages = [("greenhouse", "a", '{"jobs":[{"id":1,"title":"Intern","location":{"name":"Remote US"},"absolute_url":"u"}]}'), ("lever", "b", '[{"id":"x","text":"Co-op","categories":{"location":"NYC"},"createdAt":5}]'), ("ashby", "c", '{"jobs":[]}'), ("other", "d", "{}")]
    df = spark.createDataFrame(pages, "kind string, board string, body string")
    got = {(r.kind, r.source_job_id, r.workplace) for r in readers.postings(df).collect()}
    assert got == {("greenhouse", "1", "Remote"), ("lever", "x", "OnSite")}
    assert [r.board for r in readers.unsupported(df).collect()] == ["d"]
    feed = spark.createDataFrame([("f", "<tr><td>Acme</td><td>A</td><td>NYC</td><td><a href='u1'>x</a></td></tr><tr><td>↳</td><td>B</td><td>LA</td><td><a href='u2'>x</a></td></tr>")], "feed string, body string")
    assert [(r.company, r.title, r.url) for r in readers.table_feed(feed).orderBy("pos").collect()] == [("Acme", "A", "u1"), ("Acme", "B", "u2")]
    pipes = spark.createDataFrame([("f", "| Company | Role | Place |\n|---|---|---|\n| Acme | A | NYC |")], "feed string, body string")
    assert [(r.company, r.title, r.location) for r in readers.pipe_feed(pipes).collect()] == [("Acme", "A", "NYC")]
    assert column(spark, ["aGk_", "aGk-"], readers.mail_body) == ["hi?", "hi>"]
