"""Aggregates and ordered-window operators of the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, key: str, known: Sequence[str]) -> DataFrame:
    """Known groups with their counts, 0 where there is none; unknown groups are left out."""
    spark: SparkSession = counts.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, known))).alias(key))
    values = [c for c in counts.columns if c != key]
    return dim.join(counts, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in values])


def age_buckets(ts: Column, now: Column) -> dict[str, Column]:
    """Counts of rows up to 24 hours, 72 hours and over 14 days old; null ages are in none."""
    return {"within_24h": ts >= now - F.expr("interval 24 hours"), "within_72h": ts >= now - F.expr("interval 72 hours"), "over_14d": ts < now - F.expr("interval 14 days")}


def nearest_rank(value: str, *shares: float) -> list[Column]:
    """Exact percentiles that are values of the column."""
    return [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in shares]


def fingerprint(rows: DataFrame, by: str, order: str, text: Column) -> DataFrame:
    """SHA-256 of each group's trimmed texts in order, as a JSON array, so that no text runs into the next."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t")))), lambda x: F.trim(x.t))
    return rows.groupBy(by).agg(F.sha2(F.to_json(parts), 256).alias("fingerprint"), F.count("*").alias("n"))


def forward_filled(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null value up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def rotating_sample(rows: DataFrame, by: Sequence[str], order: Sequence[Column], newest: int, budget: int, turn: int) -> DataFrame:
    """Per group the newest rows, and a stretch of the rest that moves on with each turn."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    tail = F.greatest(F.col("n") - newest, F.lit(1))
    rotated = F.pmod(F.col("place") - newest - F.lit(turn * budget), tail)
    return out.where((F.col("place") < newest) | (rotated < budget)).drop("n")


def priority_fill(rows: DataFrame, rank: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows in order of priority, then ``order``, up to a limit."""
    return rows.withColumn("priority_rank", rank).orderBy("priority_rank", *order).limit(limit)


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Parents with their children as an ordered array, empty if there are none."""
    groups = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("children"))
    return parents.join(groups, key, "left").withColumn("children", F.coalesce("children", F.array()))


def missing_work(owners: DataFrame, items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every (owner, item) pair not yet done.

    The pairs are the result itself, so this is a product by design; ``owners``
    should be the small side.
    """
    return owners.crossJoin(items).join(done.select(*keys), list(keys), "left_anti")
