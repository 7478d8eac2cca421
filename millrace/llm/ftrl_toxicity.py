"""Toxicity by logistic regression trained with FTRL-proximal.

Features are the hashed word n-grams (one and two words, and one word cut to its
first ``STEM`` letters, since languages inflect) and skip-grams (two words with one
between them) that a whole text holds, present or not.  Training
follows the per-coordinate FTRL-proximal rule with L1 and L2 terms over a bounded
sample of labelled documents (``MAX_PER_CLASS`` of each class) in a repeatable
order, another one in each epoch.  One task reads the sorted sample as a stream and
holds the coordinates and one document; the L1 term leaves few weights, and only
these, a sparse list of at most ``2 ** BITS`` entries, reach the driver and are
broadcast.  Scoring is one map pass.

The bias is learnt without L1, so a document without any weighted feature scores
as low as the sample's share of toxic documents suggests.

Defined results: null and empty texts have no features and score by the bias
alone; repeated rows score alike; without usable labels every score is 0.5 (an
untrained model says nothing) and an empty table gives no rows; texts of any length
are read whole, in memory that grows with the longest one.  A labelled id that is
repeated counts once, with one of its texts; other columns are carried along.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import evict, fold, read, ship
from .labelled import fitted, labelled_sample

MAX_PER_CLASS = 4000
BITS = 18
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
EPOCHS = 4
#: Inflected forms share the hash of this many first letters.
STEM = 4
THRESHOLD = 0.3
#: Buckets of a document in a row of the sample; longer ones take several.
PART = 4096
CACHE_ENTRIES = 500_000
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Words to the hashes of word and stem, as 16 bytes."""

    def __missing__(self, word: str) -> bytes:
        evict(self, CACHE_ENTRIES)
        one, stem = ((crc32(w.encode()) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for w in (word, word[:STEM] + "*"))
        found = self[word] = np.array([one, stem], "<u8").tobytes()
        return found


def buckets(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Buckets (maybe repeated) of the n-grams and skip-grams of a whole text."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    h, stems = np.frombuffer(b"".join(map(hashes.__getitem__, words)), "<u8").reshape(-1, 2).T
    pairs = h[:-1] * np.uint64(3) + h[1:]
    skips = h[:-2] * np.uint64(5) + h[2:] * np.uint64(7)
    return buckets(np.concatenate([h, stems, pairs, skips]))


@dataclass
class Weights:
    """Sparse weights, small enough to broadcast."""

    at: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.at] = self.value
        return w


def train(rows: Iterable[tuple[np.ndarray, int]]) -> Weights:
    """FTRL-proximal over (present buckets, label) rows, in the order given."""
    n, z = np.zeros(1 << BITS), np.zeros(1 << BITS)
    n0 = z0 = 0.0

    def current(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    def current_bias() -> float:
        return -z0 / ((BETA + n0**0.5) / ALPHA)

    for at, y in rows:
        w, b = current(at), current_bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
        g = p - y
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g
        sigma0 = ((n0 + g * g) ** 0.5 - n0**0.5) / ALPHA
        z0 += g - sigma0 * b
        n0 += g * g
    w = current(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return Weights(at, w[at].astype(np.float32), float(current_bias()))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Whole documents from the rows (doc_id, y, part, parts, at) of their parts."""
    held: list[np.ndarray] = []
    for batch in batches:
        for y, parts, at in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
            held.append(np.frombuffer(at, np.int32))
            if len(held) == parts:
                yield np.concatenate(held), y
                held = []


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: int = MAX_PER_CLASS) -> Weights:
    """Train on a bounded sample, which one task reads as a stream, once an epoch."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, part, parts, at = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                found = np.unique(features(text.as_py(), hashes)).astype(np.int32)
                cuts = [found[k : k + PART].tobytes() for k in range(0, max(1, len(found)), PART)]
                rows += [row] * len(cuts)
                part += range(len(cuts))
                parts += [len(cuts)] * len(cuts)
                at += cuts
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(2).take(picked), pa.array(part, pa.int32()), pa.array(parts, pa.int32()), pa.array(at, pa.binary())],
                ["doc_id", "y", "part", "parts", "at"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes:
        out, w = io.BytesIO(), train(joined(batches))
        np.savez(out, at=w.at, value=w.value, bias=w.bias)
        return out.getvalue()

    sample = labelled_sample(docs, labels, "toxic", usable, per_class)
    key = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(run, f"doc_id {key}, y int, part int, parts int, at binary")
    epochs = found.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).withColumn("place", F.xxhash64("epoch", "doc_id"))
    with np.load(io.BytesIO(fitted(epochs, ["epoch", "place", "doc_id", "part"], learn))) as w:
        return Weights(w["at"], w["value"], float(w["bias"]))


def score_documents(docs: DataFrame, weights: Weights, column: str = "score") -> DataFrame:
    """All columns of ``docs`` (with text) and the score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, w, bias = WordHashes(), sent.value.dense(), sent.value.bias
        for texts in batches:
            sums = []
            for text in texts:
                at = features(text, hashes)
                sums.append(w[np.unique(at[w[at] != 0])].sum(dtype=np.float64))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, np.float64) + bias, -30, 30))))

    return docs.withColumn(column, score("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), fold("doc_id", 4) != 2)
    return score_documents(docs, weights).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
