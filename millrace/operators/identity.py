"""Deduplication, identity resolution, fuzzy joins and merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order (the plan limits groups before the shuffle)."""
    return top(rows, by, order, 1)


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, number: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; the rank is kept under ``number``, if that is given."""
    rank = number or "rank_"
    while number is None and rank in rows.columns:
        rank += "_"
    out = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
    return out.drop(rank) if number is None else out


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the least by ``order`` (unique), by an aggregate that combines before its shuffle.

    Rows with a null key are all kept.
    """
    value = F.struct(*rows.columns)
    alone = F.when(F.col(key).isNull(), F.col(order))
    return rows.groupBy(F.col(key).alias("_k"), alone.alias("_alone")).agg(F.min_by(value, F.col(order)).alias("v")).select("v.*")


def duplicate_counts(rows: DataFrame, key: str) -> DataFrame:
    """total, kept, duplicates in one pass; null keys are never duplicates."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"))
    kept = F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(1))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(kept, F.lit(0)).alias("kept")).withColumn("duplicates", F.col("total") - F.col("kept"))


def without_known_urls(rows: DataFrame, key: Column, known: DataFrame, columns: Sequence[str], known_key) -> DataFrame:
    """Rows whose key isn't among the canonical forms of any of ``columns`` of ``known``; null keys stay."""
    have = known.select(F.explode(F.array(*columns)).alias("u")).select(known_key(F.col("u")).alias("_known")).where(F.col("_known").isNotNull()).distinct()
    return rows.join(have, key == have["_known"], "left_anti")


def tiered_identity(incoming: DataFrame, existing: DataFrame, tiers: Sequence[Sequence[str]], key: str, existing_key: str) -> DataFrame:
    """Each incoming row with the existing row of its first matching tier (tier from 1; nulls if none).

    A tier is a list of columns that must all be equal; a column name ending in
    ``?`` compares null-safely.  Candidates are found by one equi-join a tier and
    the least (tier, existing key) is taken by an aggregate.
    """
    out = None
    for number, columns in enumerate(tiers, 1):
        names = [c.rstrip("?") for c in columns]
        left = incoming.select(key, *[F.col(n).alias(f"l_{n}") for n in names])
        right = existing.select(F.col(existing_key).alias("match_id"), *[F.col(n).alias(f"r_{n}") for n in names])
        on = F.lit(True)
        for c, n in zip(columns, names):
            on = on & (F.col(f"l_{n}").eqNullSafe(F.col(f"r_{n}")) if c.endswith("?") else F.col(f"l_{n}") == F.col(f"r_{n}"))
        right = right.groupBy(*[f"r_{n}" for n in names]).agg(F.min("match_id").alias("match_id"))
        found = left.join(right, on).groupBy(key).agg(F.min("match_id").alias("match_id")).withColumn("tier", F.lit(number))
        out = found if out is None else out.unionByName(found)
    best = out.groupBy(key).agg(F.min(F.struct("tier", "match_id")).alias("best"))
    return incoming.join(best, key, "left").select(*incoming.columns, "best.tier", "best.match_id")


def best_match(left: DataFrame, right: DataFrame, block: Sequence[str], score: Column, left_key: str, tie: str, least: float) -> DataFrame:
    """The best-scoring right row of each left row within its block, if it scores at least ``least``."""
    scored = left.join(right, list(block)).withColumn("score", score).where(F.col("score") >= least)
    return latest(scored, [left_key], [F.desc("score"), F.col(tie).asc()])


def best_other(rows: DataFrame, block: str, name: str, key: str, tokens: Column, whole: Column, score: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """key, other, score: each row's best-scoring other row of its block, the least key on ties.

    ``score`` must be the shared tokens over the larger set, or 1 for equal ``whole``
    names.  Rows of one name are one class with its two least keys.  Classes meet on
    their rarest tokens (a score of ``least`` or more shares one of these) or on
    their whole names.
    """
    keyed = rows.select(block, name, key)
    two = top(keyed, [block, name], [F.col(key)], 2).groupBy(block, name).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    classes = two.withColumn("second", F.when(F.col("first") < F.col("last"), F.col("last"))).drop("last").withColumn("tokens", tokens)
    words = classes.select(block, name, F.size("tokens").alias("size"), F.explode("tokens").alias("t"))
    counts = words.groupBy(block, "t").agg(F.count("*").alias("_often"))
    place = F.row_number().over(Window.partitionBy(block, name).orderBy("_often", "t"))
    rare = words.join(counts, [block, "t"]).withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1)
    meet = rare.select(block, name, F.concat(F.lit("t"), "t").alias("t")).unionByName(classes.select(block, name, F.concat(F.lit("w"), whole).alias("t")))
    pairs = meet.join(meet.select(block, F.col(name).alias("to"), "t"), [block, "t"]).select(block, name, "to").distinct()
    scored = pairs.withColumn("score", score(F.col(name), F.col("to"))).where(F.col("score") >= least)
    found = scored.join(classes.select(block, F.col(name).alias("to"), "first", "second"), [block, "to"])
    others = latest(found.where(F.col(name) != F.col("to")), [block, name], [F.desc("score"), F.col("first")])
    both = found.where(F.col(name) == F.col("to")).unionByName(others)
    other = F.when(F.col("first") != F.col(key), F.col("first")).otherwise(F.col("second"))
    each = keyed.join(both, [block, name]).withColumn("other", other).where(F.col("other").isNotNull())
    return latest(each, [key], [F.desc("score"), F.col("other")]).select(key, "other", "score")


def merged(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Full outer merge with outcome new, updated, unchanged or absent; new values win."""
    o, n = old.alias("o"), new.alias("n")
    changed = F.lit(False)
    for c in compared:
        changed = changed | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    outcome = F.when(F.col(f"o.{key}").isNull(), "new").when(F.col(f"n.{key}").isNull(), "absent").when(changed, "updated").otherwise("unchanged")
    values = [F.when(F.col(f"n.{key}").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in compared]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *values, outcome.alias("outcome"))


def surest(rows: DataFrame, by: Sequence[str], rank: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Per group the values of the highest rank, the earliest on ties."""
    best = F.max_by(F.struct(*keep), F.struct(rank, *[-F.col(c) for c in order]))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def insert_missing(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows to append so that no key is inserted twice."""
    return rows.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def first_with_any_url(rows: DataFrame, key: str, scope: str, url: Column, others: DataFrame, other_key: str, columns: Sequence[str], canonical: Callable[[Column], Column]) -> DataFrame:
    """key, match_id, column: for each row the least other of its scope with the row's URL in any of ``columns``.

    ``column`` is the first of them that has it.  The others' URLs become one inverted
    table (scope, URL, least other) before the join, so a URL or a scope with any share
    of the rows is one entry; rows without a URL or without a match are left out.
    """
    urls = F.array(*[canonical(F.col(c)) for c in columns])
    inverted = others.select(F.col(scope).alias("scope"), F.col(other_key).alias("id"), F.posexplode(urls).alias("place", "url")).where("url IS NOT NULL AND scope IS NOT NULL")
    first = inverted.groupBy("scope", "url").agg(F.min(F.struct("id", "place")).alias("first"))
    wanted = rows.select(F.col(key), F.col(scope).alias("scope"), canonical(url).alias("url"))
    names = F.array(*[F.lit(c) for c in columns])
    return wanted.join(first, ["scope", "url"]).select(key, F.col("first.id").alias("match_id"), names[F.col("first.place")].alias("column"))
