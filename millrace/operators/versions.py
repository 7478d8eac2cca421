"""Replacing one owner's rows: readers see the old rows or the new ones, never a part of either."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class OwnedTable:
    """A table of rows that belong to owners, in a shared folder.

    Rows are written under a new version, partitioned by version and owner, and count
    once a commit row for the owner is there; it is written last.  A run that fails
    before that leaves the old version in place, and what it wrote is never read.  A
    read takes each owner's last committed version; its commits are one small row per
    owner and run, and old versions are pruned as partitions.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, owner: str):
        self.spark, self.folder, self.schema, self.owner = spark, folder.rstrip("/"), schema, owner
        self.kind = dict(spark.createDataFrame([], schema).dtypes)[owner]
        self.commits = f"owner_ {self.kind}, version_ string, number_ long"

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """owner_, version_, number_: the last commit of each owner."""
        return self._read("commits", self.commits).groupBy("owner_").agg(F.max_by(F.struct("version_", "number_"), "number_").alias("c")).select("owner_", "c.*")

    def read(self) -> DataFrame:
        rows = self._read("rows", f"{self.schema}, version_ string")
        now = self.current().select("owner_", "version_")
        return rows.join(now, (rows.version_ == now.version_) & rows[self.owner].eqNullSafe(now.owner_)).select(*[rows[c] for c in rows.columns if c != "version_"])

    def replace(self, rows: DataFrame, owners: DataFrame | None = None) -> None:
        """Makes ``rows`` all that their owners have; ``owners`` names further ones, that have none then."""
        version = uuid.uuid4().hex
        rows.withColumn("version_", F.lit(version)).write.mode("append").partitionBy("version_").parquet(f"{self.folder}/rows")
        written = self._read("rows", f"{self.schema}, version_ string").where(F.col("version_") == version).select(F.col(self.owner).alias("owner_")).distinct()
        named = written if owners is None else written.unionByName(owners.select(F.col(self.owner).alias("owner_"))).distinct()
        before = self._read("commits", self.commits).agg(F.coalesce(F.max("number_"), F.lit(0))).first()[0]
        named.select("owner_", F.lit(version).alias("version_"), F.lit(before + 1).cast("long").alias("number_")).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def update(self, ids: DataFrame, key: Sequence[str], changes: dict[str, Column], where: Column | None = None) -> None:
        """Changes columns of the rows whose key is in ``ids`` and for which ``where`` holds, in one commit of all their owners."""
        rows = self.read()
        wanted = ids.select(*key).distinct().withColumn("wanted_", F.lit(True))
        met = rows.join(wanted, list(key), "left")
        hit = F.col("wanted_").isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
        touched = met.where(hit).select(self.owner).distinct()
        new = met.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns])
        new = new.join(touched.withColumnRenamed(self.owner, "touched_"), F.col(self.owner).eqNullSafe(F.col("touched_")), "left_semi")
        self.replace(new)
