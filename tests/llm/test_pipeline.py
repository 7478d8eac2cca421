"""The pipeline's stages on awkward rows, and all of them in a row against brute force."""

import hashlib

import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_joins import brute_components
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from millrace.llm import bigru_langid, knn_quality, positional_index
from millrace.llm.common import read

SMALL = "/root/testdata/sf0.001"
LONG = "A longer sentence about nothing in particular that goes on for a while and then some more. " * 3


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "123 ### ²"), (9005, LONG), (9005, LONG), (None, "One without an id, but with some words."), (None, None), (9006, "word " * 20_000)]
    docs = read(spark, SMALL, "documents")
    extra = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    repeated = docs.where("doc_id = 7")
    clash = docs.unionByName(extra).unionByName(repeated).unionByName(repeated)
    for name in ("score", "found", "row_no", "key", "cid", "h", "n_tokens"):
        clash = clash.withColumn(name, F.lit("z"))
    return clash.cache()


@pytest.mark.parametrize("k", range(5))
def test_stage_on_awkward_rows(spark, awkward, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, awkward, SMALL)
    rows = [(r.doc_id, getattr(r, "text", "")) for r in out.collect()]
    if name == "tokens":
        assert len(rows) == awkward.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert [r.n_tokens for r in out.where("doc_id IN (9001, 9002)").collect() if r.n_tokens] == []
    else:
        assert out.columns == awkward.columns
        stays = {"quality": 0, "language": 0, "near_duplicates": 3, "decontamination": 3}[name]
        assert len([r for r in rows if r[0] in (9001, 9002, 9003)]) >= stays
        assert len([r for r in rows if r[0] == 9005]) in ((1,) if name == "near_duplicates" else (0, 2))
        assert len([r for r in rows if r[0] == 7]) in ((0, 1) if name == "near_duplicates" else (0, 3))
        if name == "language":
            assert not {9001, 9002, 9003, 9004} & {r[0] for r in rows}
    assert stage(spark, awkward.where("false"), SMALL).count() == 0


def test_whole_pipeline_by_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    model = knn_quality.fit(docs, read(spark, SMALL, "labels"), F.lit(True))
    terms = knn_quality.Terms()
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    good = [i for i, r in rows.items() if model.score([knn_quality.features(r.text, terms)])[0] >= knn_quality.THRESHOLD]
    net = bigru_langid.fit(docs.where(F.col("doc_id").isin(good)), F.lit(True))
    known = []
    for i in good:
        (name,), (score,) = bigru_langid.predict(net, [rows[i].text])
        if name != "und" and score >= corpus_pipeline.LEAST_LANGUAGE:
            known.append(i)
    place = {i: k for k, i in enumerate(known)}
    groups = brute_components([(place[i], rows[i].text) for i in known], 5, 4, 5)
    n_groups = len({c for _, c in groups.values()})
    windows = {w for r in read(spark, SMALL, "benchmark").collect() for w in positional_index.item_windows(r.text)}

    def holds(text):
        words = [w.decode() for w in positional_index.words_of(text)]
        return any(tuple(words[k : k + len(w)]) == w for w in windows for k in range(len(words) - len(w) + 1) if words[k] == w[0])

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) <= set(known)
    kept_groups = {groups[place[i]][1] for i in got}
    assert len(kept_groups) == len(got)  # one of each group
    contaminated = {groups[place[i]][1] for i in known if holds(rows[i].text)}
    clean = {groups[place[i]][1] for i in known} - contaminated
    assert clean <= kept_groups <= clean | {c for c in contaminated if any(groups[place[i]][1] == c and not holds(rows[i].text) for i in known)}
    assert n_groups >= len(got) and not any(holds(rows[i].text) for i in got)
    ranks = load_tiktoken_bpe(public.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        ids = enc.encode_ordinary(rows[i].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[i].text.encode()).hexdigest()
