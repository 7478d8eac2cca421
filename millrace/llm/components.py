"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step: neighbours of a node are linked to the least of them instead."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.where("v <= u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root: every linked node with the least node it can reach (roots are left out).

    ``links`` has two columns of node ids.  Each step is written to the shared
    folder; the number of steps grows with the logarithm of the longest path.
    """
    u, v = links.columns
    edges = scratch.table(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark = None
    for step in range(1, MAX_ROUNDS):
        edges = scratch.table(_stars(_stars(edges, False), True), f"{name}-{step}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
