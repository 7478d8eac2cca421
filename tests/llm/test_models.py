"""Quality, toxicity and language models: held-out accuracy and awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bigru_langid, ftrl_toxicity, knn_quality
from millrace.llm.common import fold, read

SF = "/root/testdata/sf0.1"
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 456 ###"), (5, "word " * 20_000), (5, "word " * 20_000), (None, "A text without an id."), (7, "x" * 50_000)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "z", "z") for r in AWKWARD], "doc_id long, text string, score string, found string")


def judged(scored, spark, label):
    rows = scored.where("held_out").join(read(spark, SF, "labels"), "doc_id").select("predicted", label).collect()
    return np.array([[r[0], r[1]] for r in rows])


def test_quality_held_out(spark):
    r = judged(knn_quality.query(spark, SF), spark, "quality")
    assert (r[r[:, 1] == 1][:, 0] == 1).mean() > 0.98
    assert (r[r[:, 1] == 0][:, 0] == 0).mean() > 0.9


def test_toxicity_held_out(spark):
    r = judged(ftrl_toxicity.query(spark, SF), spark, "toxic")
    assert (r[r[:, 1] == 0][:, 0] == 0).mean() > 0.98
    assert (r[r[:, 1] == 1][:, 0] == 1).mean() > 0.8


def test_language_held_out(spark):
    found = bigru_langid.query(spark, "/root/testdata/sf0.01").where("held_out").join(read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() > 0.97 * found.count()


def test_awkward_texts(spark, awkward):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    model = knn_quality.fit(docs, labels, F.lit(True))
    weights = ftrl_toxicity.fit(docs, labels, F.lit(True))
    for scored in (knn_quality.score_documents(awkward, model, "s"), ftrl_toxicity.score_documents(awkward, weights, "s")):
        rows = scored.collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.s <= 1 for r in rows) and {r.score for r in rows} == {"z"}
        assert len({r.s for r in rows if r.doc_id == 5}) == 1
    net = bigru_langid.fit(docs, F.lit(True))
    rows = {r.doc_id: r for r in bigru_langid.identify(awkward, net, "lang").collect()}
    for i in (1, 2, 3, 4):
        assert (rows[i].lang.lang_pred, rows[i].lang.score) == ("und", 0.0)
    assert rows[7].lang.lang_pred != "und"
    none = awkward.where("false")
    assert bigru_langid.identify(none, net).count() == knn_quality.score_documents(none, model, "s").count() == 0


def test_without_labels(spark, awkward):
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.s for r in knn_quality.score_documents(docs, knn_quality.fit(docs, labels, fold("doc_id", 5) != 0), "s").collect()} == {0.5}
    assert {r.s for r in ftrl_toxicity.score_documents(docs, ftrl_toxicity.fit(docs, labels, F.lit(True)), "s").collect()} == {0.5}
    assert {r.found2.lang_pred for r in bigru_langid.identify(docs, bigru_langid.fit(docs, F.lit(True)), "found2").collect()} == {"und"}


def test_gradients_by_differences():
    net = bigru_langid.new_network(["a", "b", "c"], 4)
    r = np.random.default_rng(0)
    x, y, valid = r.integers(0, 256, (6, 5)).astype(np.uint8), r.integers(0, 3, 5), (r.random((6, 5)) > 0.2).astype(np.float32)
    for name in ("inputs", "gates", "candidate", "output", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    grads = bigru_langid.gradients(net, x, y, valid)[1]
    for k, (p, g) in enumerate(zip(net.parts(), grads)):
        at = (0, 2, int(x[3, 2])) if k == 0 else tuple(r.integers(0, s) for s in p.shape)
        old, step = p[at], 1e-3
        p[at] = old + step
        up = bigru_langid.gradients(net, x, y, valid)[0]
        p[at] = old - step
        down = bigru_langid.gradients(net, x, y, valid)[0]
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=1e-5)


def test_every_byte_is_read():
    """A text's probabilities are the mean over all windows, whichever batch they fall in."""
    net = bigru_langid.new_network(["a", "b"])
    text = "".join(chr(97 + i % 26) for i in range(64 * 3))
    whole = bigru_langid.predict(net, [text])[1][0]
    sums = sum(bigru_langid.label_positions(net, np.frombuffer(text[k : k + 64].encode(), np.uint8)[:, None]).sum(axis=0)[:, 0] for k in (0, 64, 128))
    assert whole == pytest.approx(sums.max() / sums.sum(), abs=1e-5)
    assert bigru_langid.predict(net, ["x", text, None])[1][1] == pytest.approx(whole, abs=1e-5)
