"""Identity operators over all rows, against brute force."""

import random

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import identity
from millrace.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_best_other(spark):
    r = random.Random(3)
    names = [" ".join(r.choice(["red", "blue", "bolt", "ring", "old", "summer", "a", "x"]) for _ in range(r.randrange(0, 12))) for _ in range(150)]
    rows = spark.createDataFrame([(i, f"b{i % 3}", n) for i, n in enumerate(names)] + [(998, "b0", "a x"), (999, "b0", "a-x"), (1000, None, "red"), (1001, "b0", None)], "id long, b string, n string")
    n = F.col("n")
    out = identity.best_other(rows, "b", "n", "id", text.token_set(n), F.nullif(text.normalized(n), F.lit("")), text.token_similarity, 0.3)
    l, o = rows.select("id", "b", "n"), rows.select(F.col("id").alias("o"), F.col("b").alias("ob"), F.col("n").alias("on"))
    all_pairs = l.join(o, F.col("b") == F.col("ob")).where("id <> o").select("id", "o", text.token_similarity(F.col("n"), F.col("on")).alias("s")).where("s >= 0.3").collect()
    want = {}
    for p in sorted(all_pairs, key=lambda p: (-p.s, p.o)):
        want.setdefault(p.id, (p.o, p.s))
    assert {x.id: (x.other, x.score) for x in out.collect()} == want and 998 in want


def test_all_rows_take_part(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert QUERIES["tiered_identity"](spark, DATA).count() == parts
    assert QUERIES["fuzzy_best_match"](spark, DATA).where("l_key % 10 <> 0").count() > 0
