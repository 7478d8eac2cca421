"""Ingestion against a loop over the rows, the run's counters, promotion, scans and groups."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import graph, ingest, rounds, runs, scans
from millrace.operators.tables import Passing

JOB_SCHEMA = "source string, source_job_id string, company string, requisition_id string, title string, location string, official_url string, source_url string, other_url string, description string, posted_at timestamp, confidence string, classification string"
RANKS = {"UNKNOWN": 0, "DATE_ONLY": 1, "RELATIVE_PARSED": 2, "EXACT": 3}


def some_rows(seed, n):
    """Rows whose keys clash a lot, with nulls and blanks."""
    import datetime

    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    url = lambda: pick(None, "", f"https://www.a.com/{r.randrange(6)}/?utm_source=x", f"http://a.com/{r.randrange(6)}", f"https://jobright.ai/{r.randrange(4)}")
    rows = [
        (pick("s", "t"), pick(None, *map(str, range(8))), pick("A", "B", None), pick(None, " ", "R1", "R2", "R3"), pick("Eng Intern", "eng  intern!", "Eng", None), pick("X", "x ", None), url(), url(), url(),
         pick("", "d1", "d2", None), pick(None, datetime.datetime(2024, 1, r.randrange(1, 20))), pick(*RANKS, None), pick(None, "Q", "U"))
        for _ in range(n)
    ]
    return [rows[i - 1] if i % 5 == 4 else row for i, row in enumerate(rows)]


def canonical(spark, urls):
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    return dict(frame.select("u", keys.canonical_url(F.nullif(F.trim("u"), F.lit("")))).collect())


def loop(jobs, sightings, canon):
    """The same, one row after the other."""
    import re

    blank = lambda x: (x or "").strip() or None
    title = lambda x: re.sub("[^a-z0-9]+", "", (x or "").lower())
    place = lambda x: re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()
    store, outcomes = [], []

    def made(row, known, seq):
        source, sid, company, req, t, loc, off, src, other, text, at, conf, cl = row
        off, src, req = blank(off), blank(src), blank(req)
        if not known and off is None and src and "jobright" not in src:
            off = src
        return dict(source=source, sid=sid, company=company, req=req, title=t, loc=loc, off=off, src=src, other=blank(other), text=text or "", at=at, rank=RANKS.get(conf, 0), cl=cl,
                    id=seq if known else None, by=None if known else seq, last=None if known else seq, n=0 if known else 1)

    store.extend(made(row, True, i) for i, row in enumerate(jobs))
    for seq, row in enumerate(sightings):
        s = made(row, False, seq)
        off, src = blank(row[6]), blank(row[7])
        wanted = canon.get(off) if off else canon.get(src) if src else None
        tiers = [
            lambda j: s["source"] is not None and s["sid"] is not None and (j["source"], j["sid"]) == (s["source"], s["sid"]),
            lambda j: s["company"] is not None and s["req"] is not None and (j["company"], j["req"]) == (s["company"], s["req"]),
            lambda j: s["company"] is not None and wanted is not None and j["company"] == s["company"] and wanted in [canon.get(j[c]) for c in ("off", "src", "other") if j[c]],
            lambda j: s["company"] is not None and (j["company"], j["source"], title(j["title"]), place(j["loc"]), j["req"]) == (s["company"], s["source"], title(s["title"]), place(s["loc"]), s["req"]),
        ]
        met = next(((k, j) for k, f in enumerate(tiers, 1) for j in store if f(j)), None)
        if met is None:
            store.append(s)
            outcomes.append((seq, "new", None, None, seq))
            continue
        tier, j = met
        new_off = off or j["off"] or (src if src and "jobright" not in src else None)
        changed = s["text"] != j["text"] or src != j["src"] or new_off != j["off"]
        j["off"], j["last"], j["n"] = new_off, seq, j["n"] + 1
        if s["at"] is not None and (j["at"] is None or s["rank"] > j["rank"]):
            j["at"], j["rank"] = s["at"], s["rank"]
        j["cl"] = s["cl"] or j["cl"]
        if changed:
            j["text"], j["src"] = s["text"] or j["text"], src or j["src"]
        outcomes.append((seq, "updated" if changed else "unchanged", tier, j["id"], j["by"]))
    return outcomes, [(j["id"], j["by"], j["title"], j["off"], j["src"], j["text"], j["at"], j["rank"], j["cl"], j["last"], j["n"]) for j in store]


@pytest.mark.parametrize("seed", [1, 2])
def test_ingest_is_a_loop_over_the_rows(spark, seed):
    jobs, sightings = some_rows(seed, 25), some_rows(seed + 100, 120)
    canon = canonical(spark, {(u or "").strip() for row in jobs + sightings for u in row[6:9]})
    old = spark.createDataFrame([(i, *r) for i, r in enumerate(jobs)], f"job_id long, {JOB_SCHEMA}")
    new = spark.createDataFrame([(i, *r) for i, r in enumerate(sightings)], f"seq long, {JOB_SCHEMA}")
    outcomes, after = ingest.ingest(old, new, "seq", Passing(spark, "test"))
    want_outcomes, want_jobs = loop(jobs, sightings, canon)
    assert sorted(map(tuple, outcomes.collect())) == want_outcomes
    got = [(r.job_id, r.made_by, r.title, r.official_url, r.source_url, r.description or "", r.posted_at, RANKS[r.confidence], r.classification, r.last_seq, r.sightings) for r in after.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want_jobs))
    assert {o[1] for o in want_outcomes} == {"new", "updated", "unchanged"}
    assert {o[2] for o in want_outcomes} >= {None, 1, 2, 3} | ({4} if seed == 1 else set())


def test_ingest_of_empty_tables(spark):
    none = spark.createDataFrame([], f"job_id long, {JOB_SCHEMA}")
    outcomes, after = ingest.ingest(none, none.withColumnRenamed("job_id", "seq"), "seq", Passing(spark, "test"))
    assert outcomes.count() == 0
    assert after.count() == 0


def fixture(spark):
    """26 employers with 10 postings each: 5 internships, 3 full-time roles, 1 unclear title, 1 without a title."""
    employers = [(f"Employer{e}", ("greenhouse", "lever", "ashby")[e % 3], f"employer{e}", None) for e in range(26)]
    titles = [f"Software Engineer Intern {j}" if j < 5 else f"Senior Software Engineer {j}" if j < 8 else "Summer Analyst" if j == 8 else "" for j in range(10)]
    postings = [(e * 10 + j, f"Employer{e}", f"{e}-{j}", titles[j], "", None, f"https://boards.example.com/employer{e}/jobs/{e}-{j}", "Austin, TX", None, None, None) for e in range(26) for j in range(10)]
    schema = "seq long, employer string, source_job_id string, title string, description string, employment_type string, apply_url string, location string, posted_at timestamp, confidence string, requisition_id string"
    return spark.createDataFrame(employers, "employer string, source string, tenant string, error string"), spark.createDataFrame(postings, schema), spark.createDataFrame([], f"job_id long, {JOB_SCHEMA}")


def test_counters_of_a_run_in_the_job_that_writes(spark, tmp_path):
    employers, postings, jobs = fixture(spark)
    rows, after = runs.ledger(employers, postings, jobs, Passing(spark, "test"))
    seen = runs.write_ledger(rows, str(tmp_path / "ledger"))
    want = {"rows_discovered": 260, "unique_rows": 260, "qualifying": 130, "not_internship": 78, "uncertain": 26, "parse_failures": 26, "closed": 0, "inserted": 130, "updated": 0, "unchanged": 0, "duplicates_prevented": 0, "official_urls_confirmed": 130}
    assert seen == want
    one = runs.metrics(employers, postings, rows).first().asDict()
    assert {k: one[k] for k in want} == want
    assert (one["employers_checked"], one["employers_with_board"], one["employers_failed"]) == (26, 26, 0)
    assert '"reason":"REVIEW_UNCERTAIN","n":26' in one["failures_by_reason"]
    again, _ = runs.ledger(employers, postings, after.withColumn("job_id", F.coalesce("job_id", "made_by")), Passing(spark, "test"))
    assert dict(again.where("outcome IS NOT NULL").groupBy("outcome").count().collect()) == {"unchanged": 130}
    dry, _ = runs.ledger(employers, postings, jobs, Passing(spark, "test"), dry=True)
    assert dry.where("outcome IS NOT NULL").count() == 0


def test_unreadable_boards_and_shared_urls(spark):
    employers, postings, jobs = fixture(spark)
    broken = employers.withColumn("error", F.when(F.col("employer") == "Employer3", "fetch timeout"))
    shared = postings.withColumn("apply_url", F.when(F.col("seq") == 1, "https://www.boards.example.com/employer0/jobs/0-0/?utm_source=n").when(F.col("seq") == 2, "").otherwise(F.col("apply_url")))
    rows, _ = runs.ledger(broken, shared, jobs, Passing(spark, "test"))
    one = runs.metrics(broken, shared, rows).first()
    assert (one.employers_failed, one.rows_discovered, one.duplicates_prevented, one.parse_failures, one.inserted) == (1, 250, 1, 26, 123)
    assert '"reason":"BOARD_FETCH_TIMEOUT","n":1' in one.failures_by_reason
    assert '"reason":"MISSING_OFFICIAL_URL","n":1' in one.failures_by_reason


def test_any_url_by_brute_force(spark):
    rows = some_rows(5, 60)
    canon = canonical(spark, {(u or "").strip() for row in rows for u in row[6:9]})
    old = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"job_id long, {JOB_SCHEMA}")
    from millrace.operators.identity import first_with_any_url

    columns = ["official_url", "source_url", "other_url"]
    got = first_with_any_url(old.withColumnRenamed("job_id", "seq"), "seq", "company", F.col("source_url"), old, "job_id", columns, lambda c: keys.canonical_url(F.nullif(F.trim(c), F.lit(""))))
    want = []
    for i, r in enumerate(rows):
        wanted = canon.get((r[7] or "").strip()) if (r[7] or "").strip() else None
        for j, o in enumerate(rows):
            hit = [c for c, u in zip(columns, o[6:9]) if (u or "").strip() and wanted and canon[u.strip()] == wanted]
            if r[2] is not None and o[2] == r[2] and hit:
                want.append((i, j, hit[0]))
                break
    assert sorted(map(tuple, got.collect())) == want


def test_groups_and_two_keys_of_a_long_chain(spark):
    writes = itertools.count()
    passing = Passing(spark, "test")

    def cut(df):
        next(writes)
        return passing(df)

    rows = spark.range(1000).select("id", F.floor(F.col("id") / 2).alias("a"), F.floor((F.col("id") + 1) / 2).alias("b"))
    got = rounds.first_by_two_keys(rows, "id", "a", "b", cut)
    seen, want = set(), []
    for i in range(1000):
        pair = {("a", i // 2), ("b", (i + 1) // 2)}
        if not pair & seen:
            seen |= pair
            want.append(i)
    assert sorted(r[0] for r in got.collect()) == want
    assert next(writes) <= 15
    one = graph.linked_groups(spark.createDataFrame([(5, None), (6, "k"), (7, "k")], "node long, key string"), passing)
    assert sorted(map(tuple, one.collect())) == [(5, 5), (6, 6), (7, 6)]


def test_a_key_that_spans_tasks_is_scanned_in_order(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 5 > 0, F.col("id") % 7).alias("k"), "id", (F.col("id") % 11).alias("v"))
    got = scans.ordered_scan(rows, "k", [F.desc("id")], ["v"], "n long, total long", lambda v: (1, v), scans.add_states, ["k", "id"], Passing(spark, "test"))
    want, state = [], {}
    for i in range(2999, -1, -1):
        k = 1 if i % 3 else i % 7 if i % 5 else None
        n, total = state.get(k, (0, 0))
        state[k] = (n + 1, total + i % 11)
        want.append((k, i, *state[k]))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
