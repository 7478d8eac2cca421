"""Rules that once were wrong, by loops and by fixed cases in which old and new rule differ."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, keys
from millrace.operators import catalogue, summaries, work


def test_progress_by_a_loop(spark):
    r = random.Random(2)
    kinds = ["SUBMITTED", "ASSESSMENT_REQUIRED", "INTERVIEW", "OFFER", "REJECTED", "CLOSED", "OTHER"]
    events = [(u, k, r.choice(kinds)) for u in range(60) for k in range(r.randrange(1, 9))] + [(100, 0, "REJECTED"), (100, 1, "INTERVIEW")]
    want = {}
    for u, _, kind in sorted(events):
        now = want.setdefault(u, None)
        if kind in work.FINAL_STATUS or work.STATUS_RANK.get(kind, 0) > work.STATUS_RANK.get(now, 0):
            want[u] = kind
    rows = spark.createDataFrame(events, "u long, k long, s string").repartition(3)
    assert {x.u: x.status for x in work.progressed(rows, ["u"], "s", "k").collect()} == want and want[100] == "INTERVIEW"


@pytest.mark.parametrize(("text", "digits"), [("é", "440ca9b2"), ("", "811c9dc5")])
def test_hash_of_utf16_units(spark, text, digits):
    h = 0x811C9DC5
    for k in range(0, len(text.encode("utf-16be")), 2):
        h = (h ^ int.from_bytes(text.encode("utf-16be")[k : k + 2], "big")) * 0x01000193 & 0xFFFFFFFF
    got = spark.createDataFrame([(text,)], "t string").select(keys.fnv1a32(F.col("t"))).first()[0]
    assert got == f"{h:08x}" and (text or got == digits)


def test_texts_do_not_run_together(spark):
    rows = spark.createDataFrame([(1, 0, "a|b"), (2, 0, "a"), (2, 1, "b"), (3, 0, " a "), (3, 1, "b")], "g long, k long, t string")
    got = {r.g: r.fingerprint for r in summaries.fingerprint(rows, "g", "k", F.col("t")).collect()}
    assert got[1] != got[2] == got[3]


def test_ages_beyond_any_date(spark):
    rows = spark.createDataFrame([("9999999999999 years ago",), ("99999999999 years ago",), ("2 days ago",)], "t string")
    got = rows.select(dates.posted_at(F.col("t"), F.lit("2026-08-01 12:00:00").cast("timestamp")).alias("p")).select("p.confidence").collect()
    assert [r.confidence for r in got] == ["UNKNOWN", "UNKNOWN", "RELATIVE_PARSED"]


def test_source_not_available(spark):
    no, text = F.lit(False), F.lit("x")
    reason = work.review_reason(no, no, no, F.lit(None).cast("string"), F.lit(None).cast("timestamp"), F.current_timestamp(), text, text, available=no)
    assert spark.range(1).select(reason).first()[0] == "MISSING_EVIDENCE"


def _mail_by_loop(mail, jobs):
    plain = lambda s: " ".join(re.findall("[a-z0-9]+", (s or "").lower()))
    text = plain(f"{mail[1] or ''} {mail[3] or ''}")
    sender = re.search("@([A-Za-z0-9.-]+)", mail[2] or "")
    for job, _, _, requisition, _ in jobs:
        if requisition and len(requisition) >= 4 and plain(requisition) and plain(requisition) in text:
            return "requisition-id", job
    for job, _, _, _, domain in jobs:
        if sender and domain and sender[1].lower().endswith(domain.lower()):
            return "ats-domain", job
    for job, title, company, _, _ in jobs:
        if len(plain(company)) >= 3 and plain(company) in text:
            if sum(plain(j[2]) == plain(company) for j in jobs) == 1:
                return "company-name", job
            if len(plain(title)) >= 3 and plain(title) in text:
                return "job-title", job
    return None, None


def test_mails_by_a_loop(spark):
    jobs = [
        (1, "Power Intern", "Acme", "R-12/77", None), (2, "Test Intern", "ACME!", None, "Example.com"), (3, "Lab Aide", "Zeta Labs", "--7-", None),
        (4, "RF Intern", "Orbit", "abc", "orbit.io"), (5, None, None, "----", ""), (6, "RF", "orbit", None, None),
    ]
    r = random.Random(5)
    words = ["Acme", "power", "intern", "TEST", "Zeta", "labs", "orbit", "RF", "R-12", "77", "9", "é", "abc"]
    senders = ["Ann <a@mail.EXAMPLE.com>", "a@notexample.com", "nobody", None, "x@orbit.io.net", "y@orbit.io", "z@elsewhere.org"]
    mails = [(k, r.choice([None, "", "Hello"]), r.choice(senders), " ".join(r.choices(words, k=r.randrange(9)))) for k in range(150)]
    # an earlier job by its title beats a later one that is its company's only one
    mails += [(900, "Zeta Labs", None, "Acme power intern"), (901, None, None, None), (902, "", "a@notexample.com", "hi"), (903, None, None, "see zeta-labs")]
    kinds = "job_id long, title string, company string, requisition string, employer_domain string"
    got = work.mail_matches(
        spark.createDataFrame(mails, "mail_id long, subject string, from_address string, body string").repartition(3), spark.createDataFrame(jobs, kinds)
    )
    found = {x.mail_id: (x.method, x.job_id) for x in got.collect()}
    assert found == {m[0]: _mail_by_loop(m, jobs) for m in mails}
    assert found[900] == ("job-title", 1) and found[901] == (None, None) and found[902] == ("ats-domain", 2) and found[903] == ("company-name", 3)
    assert {m for m, _ in found.values()} == {None, "requisition-id", "ats-domain", "company-name", "job-title"}
    assert work.mail_matches(spark.createDataFrame([], "mail_id long, subject string, from_address string, body string"), spark.createDataFrame(jobs, kinds)).count() == 0


def test_relevant_facts(spark):
    facts = [
        (0, "education", "Computer Engineering student", None), (1, "skill", "Python", "Receiver automation"), (2, "skill", "AutoCAD", None),
        (3, "experience", "Diagnosed and repaired hardware", None), (4, "skill", None, None), (5, "skill", "the intern and you", None), (6, None, "C++, node.js", ""),
    ]
    rows = spark.createDataFrame(facts, "place long, type string, content string, detail string").repartition(3)
    kept = lambda posting, most=40: [(x.place, x.score) for x in catalogue.relevant_facts(rows, "place", posting, most).collect()]
    assert kept("Use Python to diagnose embedded hardware and analyze test results.") == [(0, 0), (1, 2), (3, 2)]
    assert kept("The intern and you: C++ or Node.js") == [(0, 0), (3, 0), (6, 3)]
    assert kept("hardware, python", 2) == [(0, 0), (3, 2)] and kept("hardware, python", 1) == [(3, 2)]
