"""What the corpus operators share: shipping code to executors and cutting lineage.

Intermediate tables go to the shared folder that the cluster names in
``spark.checkpoint.dir``, so that they survive the loss of any executor.  Only
where that setting is absent (tests on one machine) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_ROOT: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="millrace-shared-")
    return f"file://{_LOCAL_ROOT[app]}"


#: Lets Spark delete the shuffle files of an execution once its output is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, codec: str = "zstd", options: dict[str, str] | None = None) -> None:
    """Write a Parquet table; the shuffles behind it are not kept, as readers start from the files."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**(options or {})).option("compression", codec).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


class Scratch:
    """A folder of intermediate tables, removed when the application ends or on drop()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/millrace/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` and return it as read back, so later work starts from files."""
        schema = df.schema
        write(df, self.path(name), codec, options)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # the application may be gone by now
                return


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key) % n


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def evict(cache: dict, limit: int) -> None:
    """Empty a worker's cache that has outgrown its bound; entries are only recomputed."""
    if len(cache) > limit:
        cache.clear()


Query = Callable[[SparkSession, str], DataFrame]
