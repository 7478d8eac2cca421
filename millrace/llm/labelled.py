"""A bounded, repeatable sample of labelled documents, and fitting on it within one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """text and y (0 or 1) of at most ``per_class`` labelled documents of each class.

    The sample is the documents whose ids hash lowest, so it doesn't depend on
    partitions.  A document labelled twice counts as 1 if any of its labels is 1;
    null ids and labels, and labels of absent documents, are left out.  The
    chosen ids (at most twice ``per_class``) are broadcast to the documents.  A
    repeated id gives one row, with the text that hashes lowest, null only if it
    has no other.
    """
    per_doc = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [per_doc.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    return one_text(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "doc_id", "y").select("doc_id", "text", "y")


def one_text(rows: DataFrame, *by: str) -> DataFrame:
    """A row per group with the text that hashes lowest, by an aggregate that combines before its shuffle."""
    first = F.min(F.struct(F.col("text").isNull(), F.xxhash64("text"), F.col("text").alias("text")))
    return rows.groupBy(*by).agg(first.alias("_first")).select(*by, "_first.text")


def fitted(rows: DataFrame, order: Sequence[str], learn: Callable[[Iterator[pa.RecordBatch]], bytes]) -> bytes:
    """What ``learn`` makes of the rows of a bounded sample, read in order by one task.

    The driver receives the model's bytes only; a lost executor repeats the task.
    Without rows ``learn`` sees no batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([learn(batches)], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").take(1)
    return bytes(found[0]["model"]) if found else learn(iter(()))
