"""Places, claims, phrases and JSON-LD on awkward rows, by loops."""

import math
import random

from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import claims, phrases, places, work
from millrace.operators.tables import Passing
from millrace.sources import jsonld


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1.0, math.sqrt(h)))


def test_radius_joins_by_all_pairs(spark):
    r = random.Random(1)
    some = lambda n: [(i, r.choice([r.uniform(-90, 90), 89.99, -90.0, 90.0, r.uniform(40, 41)]), r.choice([r.uniform(-180, 180), 180.0, -180.0, 179.99, r.uniform(-75, -74)])) for i in range(n)]
    rows, centres = [*some(300), (900, None, 1.0)], [*some(60), (901, 1.0, None)]
    left = spark.createDataFrame(rows, "a long, lat double, lng double")
    right = spark.createDataFrame(centres, "b long, lat double, lng double")
    for radius in (5.0, 60.0, 900.0, 13000.0):
        got = sorted((x.a, x.b) for x in places.within(left, "a", right, "b", radius).collect())
        want = sorted((i, j) for i, *p in rows for j, *q in centres if None not in (*p, *q) and haversine(p, q) <= radius)
        near = {(i, j) for i, *p in rows for j, *q in centres if None not in (*p, *q) and abs(haversine(p, q) - radius) < 1e-6}
        assert len(got) == len(set(got))
        assert set(got) ^ set(want) <= near


def test_a_hot_place_is_no_all_pairs_join(spark):
    left = spark.range(2000).select("id", F.lit(10.0).alias("lat"), (F.col("id") % 40 * 9.0 - 180).alias("lng"))
    right = spark.createDataFrame([(1, 10.0, 0.0)], "b long, lat double, lng double")
    assert places.within(left, "id", right, "b", 10.0).count() == 50


def test_locations_in_many_forms(spark):
    cities, states = places.gazetteer(spark)
    said = {
        "Clifton, NJ": "city", " clifton , nj": "city", "NEW YORK CITY, ny, USA": "city", "Hoboken": "city", "Nowhere, New Jersey": "state", "Nowhere": "none", "remotely, NJ": "state", "REMOTE, NJ": "remote", ",": "none", "": "none", None: "none",
        "Austin TX": "state", "New Jersey": "state",
    }
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(said)], "location string, lat_ int")
    got = {x.location: x.precision for x in places.resolved(rows, "location", cities, states).collect()}
    assert got == said


def test_phrases_in_texts_by_a_loop(spark):
    r = random.Random(2)
    words = ["ann", "joann", "lee", "leeway", "a", "ab", "ba", "xx", "12", "3", "annlee"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(6)))) for i in range(150)] + [(900, None)]
    wanted = [" ".join(r.choice([*words, "nn", "e", "oan"]) for _ in range(r.randrange(1, 4))) for _ in range(60)] + ["", None, "absent", "ann absent"]
    left = spark.createDataFrame(texts, "id long, text string")
    right = spark.createDataFrame([(p,) for p in wanted], "phrase string")
    got = phrases.containing(left, "id", "text", right, "phrase", Passing(spark, "test")).collect()
    assert sorted(map(tuple, got)) == sorted((i, p) for i, t in texts if t for p in {p for p in wanted if p} if p in t)


def test_lookups_meet_few_candidates(spark):
    """Names that all start alike share no key."""
    names = spark.range(500).select(F.concat(F.lit("supplier"), F.lpad("id", 9, "0")).alias("name"))
    got = phrases.phrase_candidates(names, "name", "name", names.select(F.col("name").alias("phrase")), "phrase", Passing(spark, "test"))
    assert got.count() == 500
    found = work.company_lookup(names, "name", names.select(F.col("name").alias("company"), F.monotonically_increasing_id().alias("id")), "company", "id")
    assert found.where("match_id IS NULL").count() == 0


def test_claims_by_a_loop(spark):
    r = random.Random(3)
    words = ["sampling", "samples", "tests", "testing", "reliable", "sensor", "c++", "c#", "data", "x", "diagnosed"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", ".", "? ", "!"]) for _ in range(r.randrange(n)))
    stems = {"sampling": "sample", "sample": "sample", "tests": "test", "test": "test", "testing": "test", "reliable": "reliability", "diagnosed": "diagnose"}
    import re

    concept = lambda w: stems.get(w, stems.get(w[:-1] if w.endswith("s") else w, w[:-1] if w.endswith("s") else w))
    concepts = lambda t: {concept(w) for w in re.split("[^a-z0-9+#]+", t.lower()) if len(w) > 1}
    sources = [(i, text(9), r.choice(["candidate", "ordinary", None])) for i in range(60)] + [(99, None, "candidate")]
    facts = [(i, text(4)) for i in range(12)] + [(77, None)]
    wanted = [" ".join(r.choice(words) for _ in range(r.randrange(1, 3))) for _ in range(30)] + ["", "x", "unheard"]
    supported = {p for p in wanted if concepts(p) and any(concepts(p) <= concepts(t or "") for _, t in facts)}
    want = set()
    for section, t, context in sources:
        for sentence in re.split(r"(?<=[.!?])\s+", t or ""):
            if context == "candidate" and sentence:
                want |= {(section, sentence.strip(), p) for p in wanted if concepts(p) and p not in supported and concepts(p) <= concepts(sentence)}
    s = spark.createDataFrame(sources, "section long, text string, context string")
    f = spark.createDataFrame(facts, "fact_id long, text string")
    p = spark.createDataFrame([(x,) for x in wanted], "phrase string")
    cut = Passing(spark, "test")
    assert set(map(tuple, claims.unsupported_claims(s, p, f, cut).collect())) == want
    kept = {x.fact_id for x in claims.facts_without(f, p, cut).collect()}
    assert kept == {i for i, t in facts if not any(concepts(x) and concepts(x) <= concepts(t or "") for x in wanted)}
    none = spark.createDataFrame([], "phrase string")
    assert claims.unsupported_claims(s, none, f, cut).count() == 0
    assert claims.facts_without(f, none, cut).count() == len(facts)


def test_grounded_sentences_by_hand(spark):
    texts = spark.createDataFrame([(1, "I like Spark. Used Kafka daily! Hired in 2024.  plain words"), (2, None), (3, "")], "text_id long, text string")
    corpus = spark.createDataFrame([("Apache Kafka's user",), (None,)], "text string")
    got = claims.grounded(texts, corpus, Passing(spark, "test")).orderBy("sentence_no").collect()
    assert [(x.text_id, x.sentence, x.kept) for x in got] == [(1, "I like Spark.", False), (1, "Used Kafka daily!", True), (1, "Hired in 2024.", False), (1, "plain words", True)]


def test_postings_of_awkward_pages(spark):
    script = '<script type="application/ld+json">{}</script>'.format
    pages = [
        (1, None), (2, ""), (3, script("")), (4, script("[[[[[[{\"@type\":\"JobPosting\",\"title\":\"six deep\"}]]]]]]")), (5, script("[[[[{\"@type\":\"JobPosting\",\"title\":\"four deep\"}]]]]")),
        (6, script('{"@type":"JobPosting","title":"first"}') + script('{"@type":"JobPosting","title":"second"}')), (7, script('{"@type":null,"x":[1,"a",null,{"@type":["JOBPOSTING"],"title":"  ","url":"u"}]}')),
    ]
    got = jsonld.found_postings(spark.createDataFrame(pages, "id long, html string"), "id", "html").orderBy("id").collect()
    assert [(x.id, x.title, x.apply_url) for x in got] == [(5, "four deep", None), (6, "first", None), (7, None, "u")]


def test_both_forms_of_posting_dates_agree(spark):
    said = ["3 days ago", "about 2 hrs ago", "just now", "new  today", "yesterday", "2024-02-03", "2024-02-03T04:05:06Z", "2/3/2024", "Feb 3, 2024", "soon", "", None, "1700000000", "1700000000000", "99999999999999 years ago"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, posting_forms string")
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    both = dates.with_posted_at(rows.withColumn("old", dates.posted_at(F.col("posting_forms"), now)), F.col("posting_forms"), now, "new")
    assert both.columns == ["i", "posting_forms", "old", "new"]
    assert both.where("NOT (old <=> new)").count() == 0
    assert both.where("new.posted_at IS NULL").count() == 4
