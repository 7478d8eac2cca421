"""Quality by nearest-neighbour voting in a latent-semantic space.

Fitting: a bounded sample of labelled documents (``MAX_PER_CLASS`` of each class)
becomes hashed term vectors -- words in one block, word shapes with the signs
around them, line and repetition bands in another, each scaled to length one --
and a truncated singular value decomposition of that matrix gives ``DIMENSIONS``
latent axes, found by subspace iteration.  One task does this; the driver
receives the projection and the labelled latent vectors only, which have a fixed
size (``FEATURES`` and ``2 * MAX_PER_CLASS`` rows), and broadcasts them.

Scoring: one map pass over whole texts.  Documents are projected in blocks, the
block's cosine with every labelled vector is one matrix product, and the
``NEIGHBOURS`` nearest vote with their similarity.  Votes of a class are divided
by the class's size in the sample, so the score doesn't depend on how many of
each were labelled.  Blocks are filled up to one shape and scores rounded to six
places, so a document's score doesn't depend on what shares its block.

Defined results: null and empty texts, and those without any term, score by the
sample's empty vector, that is 0.0; all that are as near as the last of the
nearest neighbours vote too; repeated rows get equal scores; without any usable
label every score is 0.5; an empty table gives no rows.  A labelled id that is
repeated counts once, with one of its texts; other columns are carried along.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import evict, fold, read, ship
from .labelled import fitted, labelled_sample

MAX_PER_CLASS = 1500
DIMENSIONS = 64
WORD_FEATURES, SHAPE_FEATURES = 1 << 13, 1 << 10
FEATURES = WORD_FEATURES + SHAPE_FEATURES
NEIGHBOURS = 25
THRESHOLD = 0.3
BLOCK = 256
#: Of the subspace iteration.
SPARE_AXES, ITERATIONS = 16, 25
CACHE_ENTRIES = 400_000
TERM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Terms(dict):
    """Token to (word feature, shape number)."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, token: str) -> tuple[int, int]:
        evict(self, CACHE_ENTRIES)
        first = token[0]
        if first.isalpha():
            shape = "Xx" if token.istitle() and len(token) > 1 else "X" if token.isupper() else "x" if token.islower() else "xX"
        else:
            shape = "9" if first.isdigit() else token[:3]
        word = zlib.crc32(token.lower().encode()) % WORD_FEATURES
        number = zlib.crc32(shape.encode()) % 509
        found = self[token] = (word, number)
        return found


def band(share: float) -> int:
    """A share on a scale of ten."""
    return min(9, int(share * 10))


def features(text: str | None, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their counts in one whole text, ascending."""
    text = text or ""
    tokens = TERM.findall(text)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.array(list(map(terms.__getitem__, tokens)), np.int64)
    words, shapes = both[:, 0], both[:, 1]
    pairs = (shapes[:-1] * 31 + shapes[1:]) % (SHAPE_FEATURES - 64) + 32
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(np.unique(words))
    doc = [band(distinct / len(tokens)), 10 + band(len(set(lines)) / max(1, len(lines))), 20 + min(11, len(tokens).bit_length())]
    ids = np.concatenate([words, WORD_FEATURES + shapes % 32, WORD_FEATURES + pairs, np.full(1, WORD_FEATURES + SHAPE_FEATURES - 32 + doc[0]), np.full(1, WORD_FEATURES + SHAPE_FEATURES - 22 + doc[1] - 10)])
    return np.unique(ids, return_counts=True)


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, words and shapes each scaled to length one."""
    w = ((1 + np.log(counts)) * idf[ids]).astype(np.float32)
    shape = ids >= WORD_FEATURES
    for part, scale in ((~shape, 0.6), (shape, 1.0)):
        norm = np.sqrt((w[part] ** 2).sum())
        if norm > 0:
            w[part] *= scale / norm
    return w


@dataclass
class Model:
    """What is broadcast: idf, projection, labelled unit vectors, their votes."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray  # one row a class: a neighbour's weight if it is of that class

    def latent(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(docs), self.projection.shape[1]), np.float32)
        for i, (ids, counts) in enumerate(docs):
            if len(ids):
                out[i] = weighted(ids, counts, self.idf) @ self.projection[ids]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of at most BLOCK documents."""
        if not len(self.vectors):
            return np.full(len(docs), 0.5)
        at = np.zeros((BLOCK, self.vectors.shape[1]), np.float32)
        at[: len(docs)] = self.latent(docs)
        weight = np.maximum(at @ self.vectors.T, 0)
        k = min(NEIGHBOURS, weight.shape[1])
        last = np.partition(weight, -k, axis=1)[:, -k]
        weight[weight < last[:, None]] = 0
        weight *= weight
        weight *= weight
        bad, good = (weight @ self.votes.T.astype(np.float32)).astype(np.float64)[: len(docs)].T
        total = bad + good
        return np.round(np.where(total > 0, good / np.where(total > 0, total, 1), 0.0), 6)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, idf=self.idf, projection=self.projection, vectors=self.vectors, votes=self.votes)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as parts:
            return Model(parts["idf"], parts["projection"], parts["vectors"], parts["votes"])


def leading(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """About the ``k`` largest eigenvalues of a symmetric matrix, descending, with their vectors, by subspace iteration."""
    q = np.random.default_rng(1).standard_normal((len(gram), min(len(gram), k + SPARE_AXES))).astype(gram.dtype)
    for _ in range(ITERATIONS):
        q = np.linalg.qr(gram @ q)[0]
    values, vectors = np.linalg.eigh((q.T @ (gram @ q)).astype(np.float64))
    return values[::-1][:k], q @ vectors[:, ::-1][:, :k]


def fit_model(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Latent axes of the labelled sample by its Gram matrix (rows x rows)."""
    n = len(rows)
    df = np.zeros(FEATURES)
    for ids, _, _ in rows:
        df[ids] += 1
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not n:
        return Model(idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros((2, 0)))
    weights = [weighted(ids, counts, idf) for ids, counts, _ in rows]
    gram = np.zeros((n, n), np.float32)
    for start in range(0, FEATURES, 2048):  # in blocks of columns, so the dense matrix stays small
        block = np.zeros((n, 2048), np.float32)
        for i, (ids, _, _) in enumerate(rows):
            here = (ids >= start) & (ids < start + 2048)
            block[i, ids[here] - start] = weights[i][here]
        gram += block @ block.T
    k = min(DIMENSIONS, n)
    values, vectors = leading(gram, k)
    scaled = vectors / np.sqrt(np.maximum(values, 1e-9))
    projection = np.zeros((FEATURES, k))
    for i, (ids, _, _) in enumerate(rows):
        projection[ids] += weights[i][:, None] * scaled[i]
    y = np.array([r[2] for r in rows])
    votes = np.stack([(y == c) / max(1, (y == c).sum()) for c in (0, 1)])
    model = Model(idf, projection.astype(np.float32), np.zeros((0, k), np.float32), votes)
    model.vectors = model.latent([(ids, counts) for ids, counts, _ in rows])
    return model


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on a bounded sample: at most ``2 * per_class`` rows of at most FEATURES counts come to one task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [features(x.as_py(), terms) for x in batch.column(1)]
            parts = [pa.array([np.asarray(f[i], np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *parts], ["doc_id", "y", "ids", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes:
        rows = []
        for batch in batches:
            for y, ids, counts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                rows.append((np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32), y))
        return fit_model(rows).packed()

    sample = labelled_sample(docs, labels, "quality", usable, per_class)
    key = sample.schema["doc_id"].dataType.simpleString()
    return Model.unpacked(fitted(sample.mapInArrow(run, f"doc_id {key}, y int, ids binary, counts binary"), ["doc_id"], learn))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` (with text) and the score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            found = []
            for at in range(0, len(texts), BLOCK):
                found.append(sent.value.score([features(t, terms) for t in texts.iloc[at : at + BLOCK]]))
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(column, score("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"), fold("doc_id", 5) != 0)
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
