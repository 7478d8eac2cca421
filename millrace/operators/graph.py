"""Groups of rows that share keys, directly or through other rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linked_groups(keys: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root: each node with the least node that it is linked to through shared keys."""
    nodes = keys.select("node").distinct()
    return nodes.join(linked_roots(keys, cut), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def linked_roots(keys: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root: the nodes that are linked to a lesser one, with the least of these; all others are their own roots.

    ``keys`` has columns node (long) and key; null keys link nothing.  A key ties its
    nodes to its least one, so a key with any share of the rows gives one link a row.
    Then neighbours of a node and the node itself are tied to the least among them,
    first the greater neighbours, then the others, until all nodes are tied to their
    roots alone; the number of rounds grows with the logarithm of the longest chain.
    Each round is written.
    """
    held = keys.where("key IS NOT NULL").select("node", "key")
    least = held.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    links = cut(held.join(least, "key").where("node > low").select(F.col("node").alias("up"), F.col("low").alias("down")).distinct())
    while not _settled(links):
        links = cut(_tied(_tied(links, greater=True), greater=False))
    return links.select(F.col("up").alias("node"), F.col("down").alias("root"))


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link, and no root has any up to another."""
    if not links.groupBy("up").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.select("up").join(links.select(F.col("down").alias("up")), "up", "left_semi").isEmpty()


def _tied(links: DataFrame, greater: bool) -> DataFrame:
    """``links`` (up > down) with each node's neighbours tied to the least of them: its greater ones, or its lesser ones and itself."""
    if not greater:
        lowest = links.groupBy("up").agg(F.min("down").alias("low"))
        return links.join(lowest, "up").select(F.explode(F.array(F.col("up"), F.col("down"))).alias("up"), F.col("low").alias("down")).where("up > down").distinct()
    sides = links.select(F.col("up").alias("node"), F.col("down").alias("other")).unionByName(links.select(F.col("down").alias("node"), F.col("up").alias("other")))
    lowest = sides.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return sides.where("other > node").join(lowest, "node").select(F.col("other").alias("up"), F.col("low").alias("down")).where("up > down").distinct()
