"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of ``STEPS``; within a window one
recurrence runs forwards and one backwards, and their states label every byte
position with probabilities over the learned languages.  A document's
probabilities are the mean over all of its positions; the best one is the
prediction and its probability the score.  States start anew in each window,
which lets whole texts of any length run as columns of one matrix, all bytes
being read.  Matrices have one shape and scores six places, so a result doesn't
depend on the texts beside it.

Training is backpropagation through time in numpy, with Adam, on windows of a
bounded sample: at most ``DOCS_PER_LANGUAGE`` documents of each language and
``WINDOWS_PER_DOC`` windows of each.  The weights are a few kilobytes and are
broadcast; prediction is one map pass.

Defined results: ``und`` and score 0 for null texts and texts without a letter, and
for all texts if no language could be learned; ties go to the language that sorts
first; rows with null language or id are never learned from; repeated rows get
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, read, ship
from .labelled import one_text

STEPS, UNITS = 64, 8
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, MAX_LANGUAGES = 400, 8, 200
ROUNDS, BATCH, RATE = 220, 256, 0.02
COLUMNS, TEXTS = 1024, 1024
UNKNOWN = "und"


@dataclass
class Network:
    """Weights by direction (first axis): byte inputs, gates, candidate; and the output layer."""

    languages: list[str]
    inputs: np.ndarray  # 2 x 3H x 256, biases included
    gates: np.ndarray  # 2 x 2H x H
    candidate: np.ndarray  # 2 x H x H
    output: np.ndarray  # L x 2H
    bias: np.ndarray  # L x 1

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.candidate, self.output, self.bias]


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter in the sense of Unicode; digits, fractions and numerals aren't."""
    return any(map(str.isalpha, text or ""))


def new_network(languages: list[str], units: int = UNITS) -> Network:
    r = np.random.default_rng(8)
    draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return Network(
        languages, draw(2, 3 * units, 256, scale=0.3), draw(2, 2 * units, units, scale=0.3), draw(2, units, units, scale=0.3),
        draw(len(languages), 2 * units, scale=0.3), np.zeros((len(languages), 1), np.float32),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the tangent, which is vectorized."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def both_ways(x: np.ndarray) -> np.ndarray:
    """Windows (steps x columns) read forwards and backwards."""
    return np.stack([x, x[::-1]])


def softmax(a: np.ndarray) -> np.ndarray:
    a -= a.max(axis=-2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=-2, keepdims=True)
    return a


def label_positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities, steps x languages x columns, for windows of bytes (steps x columns)."""
    units, columns = net.candidate.shape[1], x.shape[1]
    xx = both_ways(x).astype(np.intp)
    h = np.zeros((2, units, columns), np.float32)
    states = np.empty((2, len(x), units, columns), np.float32)
    g = np.empty((2, 3 * units, columns), np.float32)
    a, m = np.empty((2, 2 * units, columns), np.float32), np.empty_like(h)
    for t in range(len(x)):
        for d in (0, 1):
            np.take(net.inputs[d], xx[d, t], axis=1, out=g[d], mode="clip")
        np.matmul(net.gates, h, out=a)
        np.matmul(net.candidate, h, out=m)
        a += g[:, : 2 * units]
        sigmoid(a)
        m *= a[:, units:]
        m += g[:, 2 * units :]
        np.tanh(m, out=m)
        h -= m
        h *= a[:, :units]
        h += m
        states[0, t], states[1, -1 - t] = h[0], h[1]
    out = net.output[:, :units] @ states[0]
    out += net.output[:, units:] @ states[1]
    out += net.bias
    return softmax(out)


def gradients(net: Network, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over valid positions and its gradients, by backpropagation through time."""
    units, steps, columns = net.candidate.shape[1], *x.shape
    xx = both_ways(x).astype(np.intp)
    g = np.stack([net.inputs[d][:, xx[d]] for d in (0, 1)])  # 2 x 3H x steps x columns
    h = np.zeros((steps + 1, 2, units, columns), np.float32)
    gates, cand, mixed = (np.zeros((steps, 2, k, columns), np.float32) for k in (2 * units, units, units))
    for t in range(steps):
        gates[t] = sigmoid(net.gates @ h[t] + g[:, : 2 * units, t])
        mixed[t] = net.candidate @ h[t]
        cand[t] = np.tanh(g[:, 2 * units :, t] + gates[t, :, units:] * mixed[t])
        h[t + 1] = cand[t] + gates[t, :, :units] * (h[t] - cand[t])
    top = np.concatenate([h[1:, 0], h[1:, 1][::-1]], axis=1)  # steps x 2H x columns
    p = softmax(net.output @ top + net.bias)
    n = max(1, int(valid.sum()))
    picked = np.take_along_axis(p, np.broadcast_to(y[None, None, :], (steps, 1, columns)), axis=1)[:, 0]
    loss = float(-(np.log(picked + 1e-9) * valid).sum() / n)
    d = p
    np.put_along_axis(d, np.broadcast_to(y[None, None, :], (steps, 1, columns)), picked[:, None] - 1, axis=1)
    d *= valid[:, None, :] / n
    d_output = np.einsum("tlc,tuc->lu", d, top, optimize=True)
    d_top = net.output.T @ d
    d_states = np.stack([d_top[:, :units], d_top[::-1, units:]], axis=1)  # steps x 2 x H x columns
    d_gates, d_candidate = np.zeros_like(net.gates), np.zeros_like(net.candidate)
    d_g = np.zeros_like(g)
    d_h = np.zeros((2, units, columns), np.float32)
    for t in range(steps - 1, -1, -1):
        d_h += d_states[t]
        z, r = gates[t, :, :units], gates[t, :, units:]
        d_n = d_h * (1 - z) * (1 - cand[t] ** 2)
        d_z = d_h * (h[t] - cand[t]) * z * (1 - z)
        d_r = d_n * mixed[t] * r * (1 - r)
        d_m = d_n * r
        d_a = np.concatenate([d_z, d_r], axis=1)
        d_gates += d_a @ h[t].transpose(0, 2, 1)
        d_candidate += d_m @ h[t].transpose(0, 2, 1)
        d_g[:, : 2 * units, t], d_g[:, 2 * units :, t] = d_a, d_n
        d_h = d_h * z + net.gates.transpose(0, 2, 1) @ d_a + net.candidate.transpose(0, 2, 1) @ d_m
    d_inputs = np.stack([[np.bincount(xx[k].ravel(), weights=row.ravel(), minlength=256) for row in d_g[k]] for k in (0, 1)]).astype(np.float32)
    return loss, [d_inputs, d_gates, d_candidate, d_output, d.sum(axis=(0, 2))[:, None]]


def train(windows: list[bytes], languages: list[str]) -> Network:
    """Adam over random batches with as many windows of each language."""
    names = sorted(set(languages))
    net = new_network(names)
    if len(names) < 2:
        return net
    x = np.zeros((len(windows), STEPS), np.uint8)
    valid = np.zeros((len(windows), STEPS), np.float32)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
        valid[i, : len(w)] = 1
    y = np.array([names.index(lang) for lang in languages])
    of = [np.flatnonzero(y == k) for k in range(len(names))]
    r = np.random.default_rng(9)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, ROUNDS + 1):
        pick = np.concatenate([r.choice(o, max(1, BATCH // len(names))) for o in of])
        _, grads = gradients(net, x[pick].T, y[pick], valid[pick].T)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / ROUNDS)
        for p, g, m, v in zip(net.parts(), grads, first, second):
            g = g * min(1, 1 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores of whole texts."""
    data = [t.encode() if has_letter(t) else b"" for t in texts]
    sums = np.zeros((len(texts), len(net.languages)))
    windows = np.array([-(-len(b) // STEPS) for b in data], np.int64)
    padded = np.frombuffer(b"".join(b.ljust(int(w) * STEPS, b"\0") for b, w in zip(data, windows)), np.uint8).reshape(-1, STEPS)
    owner = np.repeat(np.arange(len(texts)), windows)
    left = np.full(len(padded), STEPS)
    ends = np.cumsum(windows)[windows > 0] - 1
    left[ends] = np.array([(len(b) - 1) % STEPS + 1 for b in data if b], np.int64)
    if len(net.languages) > 1:
        for at in range(0, len(padded), COLUMNS):
            block = padded[at : at + COLUMNS]
            filled = np.zeros((COLUMNS, STEPS), np.uint8)  # one shape, so that results don't depend on what shares a block
            filled[: len(block)] = block
            p = label_positions(net, filled.T)[:, :, : len(block)]
            p *= np.arange(STEPS)[:, None, None] < left[at : at + COLUMNS]
            np.add.at(sums, owner[at : at + COLUMNS], p.sum(axis=0).T)
    else:
        sums[:] = (windows > 0)[:, None]
    total = sums.sum(axis=1)
    sums = np.round(sums / np.where(total > 0, total, 1)[:, None], 6)  # ties are what six places can't tell apart
    best = sums.argmax(axis=1) if sums.shape[1] else np.zeros(len(texts), int)
    known = total > 0
    score = np.where(known, sums.max(axis=1, initial=0), 0.0)
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.clip(score, 0, 1)


def language_sample(rows: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """doc_id, lang and one text of the ids that hash lowest in each language, of which ``counts`` gives the distinct ids.

    Only hashes under twice the share wanted are ranked: few rows, and enough of them.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 2 * per_language / n))])
    near = rows.where(place < share[F.col("lang")] * float(1 << 40))
    lowest = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = near.select("lang", "doc_id").distinct().withColumn("_rank", F.row_number().over(lowest)).where(F.col("_rank") <= per_language).drop("_rank")
    return one_text(near.select("doc_id", "lang", "text").join(F.broadcast(ids), ["lang", "doc_id"]), "doc_id", "lang")


def fit(docs: DataFrame, usable: Column) -> Network:
    """Train on windows of a bounded sample: the documents whose ids hash lowest, language by language."""
    ship(docs.sparkSession)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    distinct = rows.select("lang", "doc_id").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in distinct.limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not counts:
        return new_network([])
    chosen = language_sample(rows, counts, DOCS_PER_LANGUAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                data = text.encode()
                step = max(STEPS, len(data) // WINDOWS_PER_DOC)
                out += [(batch.column(0)[row].as_py(), k, lang, data[at : at + STEPS]) for k, at in enumerate(range(0, len(data), step)) if k < WINDOWS_PER_DOC and has_letter(text)]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array([str(v) for v in columns[0]], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())], ["id", "k", "lang", "bytes"])

    got = chosen.select("doc_id", "lang", "text").mapInArrow(run, "id string, k int, lang string, bytes binary").toArrow().sort_by([("id", "ascending"), ("k", "ascending"), ("bytes", "ascending")])
    return train(got.column("bytes").to_pylist(), got.column("lang").to_pylist())


def identify(docs: DataFrame, net: Network, column: str = "found") -> DataFrame:
    """All columns of ``docs`` (with text) and a struct of lang_pred and score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found: list[tuple[list[str], np.ndarray]] = [predict(sent.value, list(texts.iloc[at : at + TEXTS])) for at in range(0, len(texts), TEXTS)]
            yield pd.DataFrame({"lang_pred": [x for f in found for x in f[0]], "score": np.concatenate([f[1] for f in found]) if found else np.zeros(0)})

    return docs.withColumn(column, run("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs, fold("doc_id", 3) != 1)
    return identify(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "found.lang_pred", "found.score")
