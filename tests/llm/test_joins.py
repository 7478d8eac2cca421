"""Prefix-tree join, components, positional index and pipeline against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import positional_index, prefix_tree_join
from millrace.llm.common import Scratch, read
from millrace.llm.components import components

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_components(rows, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(spark, rows, n, num, den):
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, key string, cid string").repartition(3)
    out = prefix_tree_join.jaccard_components(docs, n, num, den, Scratch(spark, "test")).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_near_copies_by_brute_force(spark, monkeypatch, n, num, den, small):
    """Groups of near copies around the threshold, common passages; with blocks of the default size and with small ones."""
    for name, size in (("BLOCK", 5), ("NEAR_BLOCK", 4), ("HUB", 7)) if small else ():
        monkeypatch.setattr(prefix_tree_join, name, size)
    r = random.Random(n)
    common = " ".join(f"c{k}" for k in range(30))
    rows = []
    for g in range(8):
        base = [f"v{r.randrange(300)}" for _ in range(r.choice([4, 20, 60, 150]))]
        for _ in range(r.choice([2, 5, 25])):
            rows.append((len(rows), edited(r, base, r.choice([0, 0, 1, 1, 2, 3]))))
    rows += [(len(rows) + k, f"{common} " + " ".join(f"v{r.randrange(300)}" for _ in range(r.randrange(6)))) for k in range(30)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "w " * 5000), (1007, "w " * 5001), (1008, "\u00c9 a b c"), (1009, "\u00e9 a b c")]
    assert found(spark, rows, n, num, den) == brute_components(rows, n, num, den)


def test_second_walk_alone(spark, monkeypatch):
    """Without the first walk's contraction the second finds every link."""
    monkeypatch.setattr(prefix_tree_join, "PICKS", 0)
    monkeypatch.setattr(prefix_tree_join, "BLOCK", 5)
    r = random.Random(8)
    rows = []
    for _ in range(12):
        base = [f"v{r.randrange(300)}" for _ in range(r.choice([10, 40, 90]))]
        rows += [(len(rows) + k, edited(r, base, k % 3)) for k in range(r.choice([2, 9, 20]))]
    assert found(spark, rows, 3, 9, 10) == brute_components(rows, 3, 9, 10)


def test_links_come_from_the_tree(spark, monkeypatch):
    """On the tables of scale 0.1 every verified link is a pair that a walk of the tree yielded, and all linked classes are reached."""
    yielded = set()
    walked = prefix_tree_join.walked

    def kept(*args):
        out = walked(*args)
        yielded.update((min(p), max(p)) for p in out.collect())
        return out

    monkeypatch.setattr(prefix_tree_join, "walked", kept)
    links = []
    verified = prefix_tree_join.verified
    monkeypatch.setattr(prefix_tree_join, "verified", lambda *a: links.append(verified(*a)) or links[-1])
    docs = read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in prefix_tree_join.jaccard_components(docs, 3, 9, 10, Scratch(spark, "test")).collect()}
    linked = {(min(p), max(p)) for found in links for p in found.collect()}
    assert linked and linked <= yielded
    texts = {r.doc_id: shingle_set(r.text, 3) for r in docs.collect()}
    at = defaultdict(list)
    for i, found_set in texts.items():
        for g in found_set:
            at[g].append(i)
    root = {}
    for i, own in texts.items():  # every document against all that share one of its rarest shingles
        for g in sorted(own, key=lambda g: (len(at[g]), g))[: len(own) - -(-9 * len(own) // 10) + 1]:
            for j in at[g]:
                other = texts[j]
                if j > i and 10 * len(own & other) >= 9 * len(own | other):
                    root.setdefault(i, set()).add(j)
    for i, others in root.items():
        assert {got[j] for j in others} == {got[i]}


def test_documents_by_brute_force(spark):
    rows = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert found(spark, rows, 3, 9, 10) == brute_components(rows, 3, 9, 10)


def test_join_of_nothing_and_repeats(spark):
    assert found(spark, [], 3, 9, 10) == {}
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (1, "x y z"), (None, None)], "doc_id long, text string")
    out = prefix_tree_join.jaccard_components(docs, 3, 9, 10, Scratch(spark, "test"))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == [("1", 1, "1"), ("1", 2, "1"), ("1", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 70)] + [(100, 200), (200, 300), (300, 300)]
    links = spark.createDataFrame(chain, "a long, b long").repartition(3)
    got = {r.node: r.root for r in components(links, Scratch(spark, "test"), "c").collect()}
    assert got == {**{k: 0 for k in range(1, 71)}, 200: 100, 300: 100}
    assert components(links.where("false"), Scratch(spark, "test"), "c").count() == 0


def index_of(spark, rows):
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, row_no string, terms string").repartition(2)
    scratch = Scratch(spark, "test")
    return scratch.table(positional_index.build_index(docs), "index"), scratch


def test_phrases_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(positional_index, "SEGMENT_WORDS", 60)
    monkeypatch.setattr(positional_index, "BLOCK_WINDOWS", 4)
    r = random.Random(4)
    word = lambda: r.choice("abcde")
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 2, 9, 10, 11, 14])))) for k in range(12)] + [(3, "a b"), (50, None), (51, "?!")]
    docs = [(k, " ".join(word() for _ in range(r.randrange(40))) + f" {items[r.randrange(12)][1].upper()}!") for k in range(25)] + [(60, None), (61, ""), (62, "a " * 300), (62, "a b"), (None, "A-b")]
    index, scratch = index_of(spark, docs)
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, what string")
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, tuple(x.item_ids)) for x in positional_index.contamination(index, bench, scratch).collect())
    want = []
    for i, t in docs:
        words, hit, owners = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER)), set(), set()
        for item, it in items:
            q = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (it or "").translate(LOWER))
            for w in {tuple(q[k : k + 10]) for k in range(max(1, len(q) - 9))} if q else ():
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        hit.update(range(k, k + len(w)))
                        owners.add(str(item))
        want.append((str(i), len(words), len(hit), tuple(sorted(owners))))
    assert got == sorted(want)
    assert positional_index.contamination(index.where("false"), bench, Scratch(spark, "test")).count() == 0
    assert positional_index.contamination(index, bench.where("false"), Scratch(spark, "test")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    index, _ = index_of(spark, [(1, "alpha x x beta y gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta")])
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    near = positional_index.proximity_matches(index, items, 3, 10).join(positional_index.directory(index), "row_no")
    assert {r.doc_id for r in near.collect()} == {1, 3}


def test_pipeline(spark):
    """Each stage keeps or drops exactly what its operator decides, and the last one round-trips."""
    docs = read(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "tokens"]
    extra = docs.limit(40).withColumn("score", F.lit("z")).withColumn("found", F.lit("z")).withColumn("row_no", F.lit("z")).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SMALL)
        assert out.columns == extra.columns
        out.collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = brute_components(rows.items(), 5, 4, 5)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}
    items = [set(positional_index.item_windows(r.text)) for r in read(spark, SMALL, "benchmark").collect()]
    windows = defaultdict(set)
    for ws in items:
        for w in ws:
            windows[len(w)].add(w)
    clean = set()
    for i, t in rows.items():
        words = [w.decode() for w in positional_index.words_of(t)]
        if not any(tuple(words[k : k + n]) in ws for n, ws in windows.items() for k in range(len(words) - n + 1)):
            clean.add(i)
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SMALL).collect()} == clean
    final = corpus_pipeline.run(spark, SMALL)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in final.collect()} <= kept & clean
