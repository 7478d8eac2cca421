"""Order-dependent deduplication on two keys, as one ordered scan per group of clashing rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import linked_groups
from .tables import Passing


def first_by_two_keys(rows: DataFrame, order: str, first: str, second: str, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What a scan in ``order`` keeps that drops rows whose first or second key a kept row has.

    ``order`` must be unique; null keys clash with nothing.  Of rows with the same two
    keys only the first can stay, so an aggregate leaves one a pair.  Then rounds keep
    the rows that come first under both keys and drop what clashes with them, as long
    as a round settles a quarter of what is left.  Rows that are still linked by shared
    keys, over any number of others (long chains), form groups, which are independent;
    finding them takes rounds that grow with the logarithm of the longest chain.  A
    group's rows stream in order, and a task holds the digests of its kept keys.
    """
    cut = cut or Passing(rows.sparkSession, "two-keys")
    kind = rows.schema[order].dataType.simpleString()
    digest = lambda side, c: F.when(F.col(c).isNotNull(), F.unhex(F.md5(F.concat(F.lit(side), F.col(c).cast("string")))))
    keyed = rows.select(F.col(order).alias("place"), digest("1", first).alias("a"), digest("2", second).alias("b"))
    free = rows.where(F.col(first).isNull() & F.col(second).isNull()).select(F.col(order).alias("place"))
    left = cut(keyed.where("a IS NOT NULL OR b IS NOT NULL").groupBy("a", "b").agg(F.min("place").alias("place")))
    kept, n = free, left.count()
    while n:
        firsts = [left.where(f"{k} IS NOT NULL").groupBy(k).agg(F.min("place").alias(f"first_{k}")) for k in "ab"]
        met = left.join(firsts[0], "a", "left").join(firsts[1], "b", "left")
        best = cut(met.where("place <= coalesce(first_a, place) AND place <= coalesce(first_b, place)").select("place", "a", "b"))
        kept = kept.unionByName(best.select("place"))
        for k in "ab":
            left = left.join(best.where(f"{k} IS NOT NULL").select(k), k, "left_anti")
        left = cut(left.select("place", "a", "b"))
        before, n = n, left.count()
        if n > before * 0.75:
            break
    if n:
        kept = kept.unionByName(_scanned(left.withColumn("node", F.monotonically_increasing_id()), kind, cut))
    return rows.join(kept, F.col(order) == F.col("place"), "left_semi").select(*rows.columns)


def _scanned(keyed: DataFrame, kind: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The places that one ordered scan of each group of linked rows keeps."""
    keyed = cut(keyed)
    groups = linked_groups(keyed.select("node", F.explode(F.array("a", "b")).alias("key")), cut)
    ordered = keyed.join(groups, "node").select("root", "place", "a", "b").repartition("root").sortWithinPartitions("root", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, set()
        for batch in batches:
            keep = []
            for root, _, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if root != at:
                    at, seen = root, set()
                fresh = a not in seen and b not in seen
                if fresh:
                    seen.update(k for k in (a, b) if k is not None)
                keep.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column(1)], ["place"]).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, f"place {kind}")
