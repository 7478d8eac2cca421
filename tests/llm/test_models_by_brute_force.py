"""The three models against plain loops: cosine vote, FTRL over dictionaries, a GRU position by position."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bigru_langid, ftrl_toxicity, knn_quality
from millrace.llm.common import fold, read

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted_model(spark):
    return knn_quality.fit(read(spark, SMALL, "documents"), read(spark, SMALL, "labels"), fold("doc_id", 5) != 0)


def plain_vote(model, text):
    """One document's score by sorting all cosines."""
    terms = knn_quality.Terms()
    ids, counts = knn_quality.features(text, terms)
    at = np.zeros(model.projection.shape[1])
    words, shapes = ({i: (1 + math.log(c)) * float(model.idf[i]) for i, c in zip(ids.tolist(), counts.tolist()) if (i < knn_quality.WORD_FEATURES) == kind} for kind in (True, False))
    for part, scale in ((words, 0.6), (shapes, 1.0)):
        norm = math.sqrt(sum(w * w for w in part.values())) or 1
        for i, w in part.items():
            at += w * scale / norm * model.projection[i].astype(np.float64)
    at /= np.linalg.norm(at) or 1
    near = sorted(((float(v.astype(np.float64) @ at), k) for k, v in enumerate(model.vectors)), reverse=True)
    last = near[knn_quality.NEIGHBOURS - 1][0]
    sums = [0.0, 0.0]
    for cosine, k in near:
        if cosine >= last - 1e-7 and cosine > 0:
            for c in (0, 1):
                sums[c] += cosine**4 * model.votes[c][k]
    return sums[1] / sum(sums) if sum(sums) else 0.0


def test_quality_vote(spark, fitted_model):
    """Whole table of the smallest scale, every labelled vector, by loops."""
    rows = knn_quality.score_documents(read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"), fitted_model).collect()
    assert len(rows) == 200
    off = [abs(plain_vote(fitted_model, r.text) - r.score) for r in rows]
    assert np.quantile(off, 0.98) < 2e-4 and max(off) < 0.05  # a tie at the last place may fall on either side


def test_quality_does_not_depend_on_blocks(spark, fitted_model):
    docs = read(spark, SMALL, "documents").select("doc_id", "text")
    whole = {r.doc_id: r.score for r in knn_quality.score_documents(docs.coalesce(1), fitted_model).collect()}
    parted = {r.doc_id: r.score for r in knn_quality.score_documents(docs.repartition(37), fitted_model).collect()}
    assert whole == parted


def test_leading_axes():
    x = np.random.default_rng(3).standard_normal((200, 40)) * np.linspace(1, 9, 40)
    gram = x @ x.T
    values, vectors = knn_quality.leading(gram, 10)
    want = np.linalg.eigvalsh(gram)[::-1][:10]
    assert values == pytest.approx(want, rel=1e-3)
    assert np.abs(gram @ vectors - vectors * values).max() < 0.05 * want[0]


def plain_ftrl(rows):
    """The rule as published, coordinate by coordinate."""
    n, z = {}, {}
    alpha, beta, l1, l2 = ftrl_toxicity.ALPHA, ftrl_toxicity.BETA, ftrl_toxicity.L1, ftrl_toxicity.L2
    n0 = z0 = 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    def bias():
        return -z0 / ((beta + math.sqrt(n0)) / alpha)

    for at, y in rows:
        w, b = {i: weight(i) for i in at}, bias()
        g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + b)))) - y
        for i in at:
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
            n[i] = old + g * g
        z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / alpha * b
        n0 += g * g
    return {i: weight(i) for i in z if weight(i)}, bias()


def test_ftrl(spark):
    """The weights of a fit on Spark are those of the plain rule on the same documents in the same order."""
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    usable = fold("doc_id", 4) != 2
    got = ftrl_toxicity.fit(docs, labels, usable)
    sample = ftrl_toxicity.labelled_sample(docs, labels, "toxic", usable, ftrl_toxicity.MAX_PER_CLASS)
    order = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(ftrl_toxicity.EPOCHS)))).orderBy("epoch", F.xxhash64("epoch", "doc_id")).select("text", "y").collect()
    hashes = ftrl_toxicity.WordHashes()
    weights, bias = plain_ftrl([(sorted(set(ftrl_toxicity.features(r.text, hashes).tolist())), r.y) for r in order])
    assert set(got.at.tolist()) == set(weights) and len(weights) > 20
    assert got.bias == pytest.approx(bias, rel=1e-6)
    assert got.value == pytest.approx([weights[i] for i in got.at.tolist()], rel=1e-4, abs=1e-6)
    scored = ftrl_toxicity.score_documents(docs.select("doc_id", "text"), got).collect()
    for r in scored[::7]:
        total = sum(weights.get(i, 0.0) for i in set(ftrl_toxicity.features(r.text, hashes).tolist())) + bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_long_documents_come_in_parts(spark, monkeypatch):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    whole = ftrl_toxicity.fit(docs, labels, F.lit(True))
    monkeypatch.setattr(ftrl_toxicity, "PART", 7)
    parted = ftrl_toxicity.fit(docs, labels, F.lit(True))
    assert whole.at.tolist() == parted.at.tolist() and whole.value == pytest.approx(parted.value)


def plain_gru(net, data):
    """Mean probabilities over all bytes, window by window, unit by unit."""
    units, total = net.candidate.shape[1], np.zeros(len(net.languages))
    sig = lambda v: 1 / (1 + math.exp(-v))
    for at in range(0, len(data), bigru_langid.STEPS):
        window = data[at : at + bigru_langid.STEPS].ljust(bigru_langid.STEPS, b"\0")
        states = []
        for d, seq in ((0, window), (1, window[::-1])):
            h, out = [0.0] * units, []
            for byte in seq:
                g = net.inputs[d][:, byte].astype(float)
                z = [sig(g[u] + sum(float(net.gates[d][u, v]) * h[v] for v in range(units))) for u in range(units)]
                r = [sig(g[units + u] + sum(float(net.gates[d][units + u, v]) * h[v] for v in range(units))) for u in range(units)]
                c = [math.tanh(g[2 * units + u] + r[u] * sum(float(net.candidate[d][u, v]) * h[v] for v in range(units))) for u in range(units)]
                h = [c[u] + z[u] * (h[u] - c[u]) for u in range(units)]
                out.append(h)
            states.append(out if d == 0 else out[::-1])
        for t in range(len(data[at : at + bigru_langid.STEPS])):
            a = [float(net.bias[k, 0]) + sum(float(net.output[k, u]) * states[0][t][u] + float(net.output[k, units + u]) * states[1][t][u] for u in range(units)) for k in range(len(total))]
            e = [math.exp(v - max(a)) for v in a]
            total += np.array(e) / sum(e)
    return total / len(data)


def test_gru_by_position():
    net = bigru_langid.new_network(["a", "b", "c"])
    r = random.Random(5)
    texts = ["".join(chr(r.randrange(97, 123)) for _ in range(n)) for n in (1, 63, 64, 65, 200)] + ["été übung œ"]
    got, scores = bigru_langid.predict(net, texts)
    for text, language, score in zip(texts, got, scores):
        want = plain_gru(net, text.encode())
        assert score == pytest.approx(want.max(), abs=2e-5) and language == net.languages[int(want.argmax())]


def test_languages_do_not_depend_on_batches(spark):
    docs = read(spark, SMALL, "documents")
    net = bigru_langid.fit(docs, F.lit(True))
    texts = [r.text for r in docs.select("text").collect()]
    whole = bigru_langid.predict(net, texts)
    for size in (1, 7, 250):
        for at in (0, 300):
            names, scores = bigru_langid.predict(net, texts[at : at + size])
            assert names == whole[0][at : at + size] and (scores == whole[1][at : at + size]).all()


@pytest.mark.parametrize(("text", "letters"), [("² ½ Ⅷ ① 123 #", False), (None, False), ("", False), ("²x", True), ("中", True)])
def test_signs_are_no_letters(text, letters):
    net = bigru_langid.new_network(["a", "b"])
    assert (bigru_langid.predict(net, [text])[0][0] != "und") == letters


def test_models_need_no_rows():
    assert knn_quality.fit_model([]).score([knn_quality.features("a b", knn_quality.Terms())]).tolist() == [0.5]
    assert ftrl_toxicity.train([]).bias == 0
