"""The pipeline's rows keep their numbers when a later scan is split otherwise."""

import random

import pytest

import corpus_pipeline
from millrace.llm.common import Scratch

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def moving(spark, monkeypatch):
    """Changes the size of splits after each table that a stage writes."""
    table, sizes = Scratch.table, ["2k", "128m"]

    def written(self, df, name, *rest):
        out = table(self, df, name, *rest)
        sizes.reverse()
        spark.conf.set(SPLIT, sizes[0])
        return out

    monkeypatch.setattr(Scratch, "table", written)
    yield
    spark.conf.unset(SPLIT)


def prose(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def stored(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(path)
    return spark.read.parquet(path)


def test_near_duplicates(spark, tmp_path, moving):
    r = random.Random(1)
    single, twice = [prose(r, 60) for _ in range(60)], [prose(r, 60) for _ in range(20)]
    near = [t + " end" for t in twice]
    docs = stored(spark, list(enumerate(single + twice + near)), str(tmp_path / "docs"))
    kept = [x.text.removesuffix(" end") for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == sorted(single + twice)


def test_decontamination(spark, tmp_path, moving):
    r = random.Random(2)
    items = [prose(r, 12) for _ in range(5)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [prose(r, 60) for _ in range(60)]
    docs = stored(spark, list(enumerate(clean + [f"{prose(r, 9)} {items[k % 5]} {prose(r, 9)}" for k in range(20)])), str(tmp_path / "docs"))
    assert sorted(x.text for x in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == sorted(clean)
