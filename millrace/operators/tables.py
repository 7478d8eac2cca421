"""Tables written on the way: lineage is cut in the cluster's shared folder, so lost executors cost nothing written."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder of ``spark.checkpoint.dir``; only where that is unset, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        root = _ROOTS.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='millrace-tables-')}"
        _ROOTS[app] = root
    return f"{root.rstrip('/')}/millrace/{label}-{uuid.uuid4().hex[:12]}"


class Passing:
    """Writes tables into a folder of its own, which goes when the application ends or on ``drop``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.count = spark, shared_folder(spark, label), 0
        atexit.register(self._end)

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back, under its own schema."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # the application may be gone by now
                return
