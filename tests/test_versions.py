"""Owned tables: failing writers, empty owners, nulls; scans that stop."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.scans import until_enough
from millrace.operators.tables import Passing
from millrace.operators.versions import OwnedTable

SCHEMA = "owner string, id long, v long"


@pytest.fixture
def table(spark, tmp_path):
    return OwnedTable(spark, str(tmp_path / "t"), SCHEMA, "owner")


def held(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_readers_see_old_or_new_rows_only(spark, table):
    assert held(table) == []
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    table.replace(rows(("a", 1, 10), ("a", 2, 20), ("b", 3, 30), (None, 4, 40)))
    before = held(table)
    assert len(before) == 4

    def broken(batches):
        for batch in batches:
            yield batch
            raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        table.replace(rows(("a", 9, 90), ("b", 9, 91)).repartition(2).mapInArrow(broken, SCHEMA))
    assert held(table) == before
    table.replace(rows(("a", 5, 50)), spark.createDataFrame([("b",)], "owner string"))
    assert held(table) == [("a", 5, 50), (None, 4, 40)]
    table.replace(rows((None, 6, 60)))
    assert held(table) == [("a", 5, 50), (None, 6, 60)]


def test_an_uncommitted_version_is_never_read(spark, table):
    table.replace(spark.createDataFrame([("a", 1, 1)], SCHEMA))
    spark.createDataFrame([("a", 2, 2)], SCHEMA).withColumn("version_", F.lit("half")).write.mode("append").partitionBy("version_").parquet(f"{table.folder}/rows")
    assert held(table) == [("a", 1, 1)]


def test_updates_by_ids_and_condition(spark, table):
    table.replace(spark.createDataFrame([("a", 1, 1), ("a", 2, None), ("b", 1, 5), ("c", 7, 9)], SCHEMA))
    table.update(spark.createDataFrame([(1,), (2,), (2,)], "id long"), ["id"], {"v": F.col("v") * 10}, F.col("v") < 5)
    assert held(table) == [("a", 1, 10), ("a", 2, None), ("b", 1, 5), ("c", 7, 9)]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_scans_that_stop_by_a_loop(spark, most):
    flags = [None if i % 5 == 0 else i % 3 == 0 for i in range(200)]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "i long, ok boolean").repartition(5)
    taken, counts = until_enough(rows, [F.desc("i")], F.col("ok"), most, Passing(spark, "test"))
    want, passed = [], 0
    for i in range(199, -1, -1):
        if flags[i]:
            want.append(i)
            if len(want) >= most:
                break
        else:
            passed += 1
    assert sorted(r.i for r in taken.collect()) == sorted(want)
    assert tuple(counts.first()) == (200, len(want), passed)
    none, zero = until_enough(rows.where("i < 0"), ["i"], F.col("ok"), most, Passing(spark, "test"))
    assert (none.count(), tuple(zero.first())) == (0, (0, 0, 0))
