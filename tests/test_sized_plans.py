"""Plans that must hold on tables larger than the fixtures, and rows that tell two rules apart."""

import duckdb
import pyarrow.parquet as pq
from conftest import bag
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import disciplines
from millrace.llm import minhash_forest, positional_index
from millrace.llm.common import Scratch
from millrace.operators import claims, ingest, places, rounds
from millrace.operators.graph import linked_groups
from millrace.operators.tables import Passing
from millrace.plans import streams


def agree_on(spark, folder, name):
    """A query and its SQL over the Parquet tables of a folder."""
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(folder))
    assert bag(got.columns, got.collect()) == bag([d[0] for d in want.description], want.fetchall())


def test_half_prices_and_repeated_names_of_firms(spark, tmp_path):
    orders = spark.range(1, 400).selectExpr("id AS o_orderkey", "id % 8 AS o_custkey", "CAST(id AS DOUBLE) + 0.5 AS o_totalprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(0, 20).selectExpr("id AS c_custkey", "format_string('Customer#%09d', id % 8) AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    agree_on(spark, tmp_path, "local_firms")


def test_a_row_group_holds_few_segments(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(250_000)), lambda i: F.hex(F.xxhash64("doc_id", i)))
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text")).coalesce(1)
    scratch = Scratch(spark, "segments-test")
    assert positional_index.written_index(docs, scratch, "index").count() == 8
    for path in scratch.spark.read.parquet(scratch.path("index")).inputFiles():
        file = pq.ParquetFile(path.removeprefix("file://"))
        assert max(file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)) <= 4


def counted_tables(spark, label):
    """A cut, and the rows of the tables that it wrote."""
    passing, rows = Passing(spark, label), []

    def cut(df):
        out = passing(df)
        rows.append(out.count())
        return out

    return cut, rows


def test_phrases_of_frequent_words_meet_no_text(spark):
    """All texts have all words, but none of 900 phrases in a row, but for one of three words and one of one."""
    line = " ".join([*(f"a{i}" for i in range(30)), *(f"b{i}" for i in range(30))])
    texts = spark.range(200).select(F.col("id").alias("text_id"), F.lit(line).alias("text"))
    said = [f"a{i} b{j}" for i in range(29) for j in range(30)] + ["a29-b0 b1", "a29 b0 b2", "b7"]
    cut, rows = counted_tables(spark, "phrases")
    got = claims.named_phrases(texts, spark.createDataFrame([(x,) for x in said], "phrase string"), cut)
    assert {r.phrase: r["count"] for r in got.groupBy("phrase").count().collect()} == {"a29-b0 b1": 200, "b7": 200}
    assert max(rows) <= 900


def test_covering_writes_no_row_for_each_word_of_a_text(spark):
    words = [f"w{i}" for i in range(50)]
    texts = spark.range(300).select("id", F.array(*map(F.lit, words)).alias("words"))
    cut, rows = counted_tables(spark, "covering")
    phrases = spark.createDataFrame([(f"w{i} x", [f"w{i}", "x"]) for i in range(50)] + [("w1 w2", ["w1", "w2"])], "phrase string, parts array<string>")
    assert claims.covering(texts, ["id"], "words", phrases, "phrase", "parts", cut).count() == 300
    assert max(rows) <= 51


def test_repeated_pairs_of_keys_reach_no_scan(spark):
    """20,000 rows of 600 pairs of keys, all of them linked."""
    rows = [(i, (i * 7919 + i // 600) % 20, i * 104729 % 30 if i % 50 else None) for i in range(20_000)]
    seen, want = (set(), set()), []
    for i, a, b in rows:
        if a not in seen[0] and b not in seen[1]:
            seen[0].add(a), seen[1].update({b} - {None}), want.append(i)
    cut, written = counted_tables(spark, "two-keys")
    got = rounds.first_by_two_keys(spark.createDataFrame(rows, "id long, a long, b long"), "id", "a", "b", cut)
    assert sorted(r.id for r in got.collect()) == want
    assert max(written) <= 620


def test_a_url_links_rows_of_one_company_unless_an_id_is_shared(spark):
    ddl = "node long, company string, id_key string, requisition_key string, title_key string, official_key string, source_key string, other_key string, direct_key string"
    row = lambda node, company, id_key, url: (node, company, id_key, None, None, url, None, None, None)
    rows = [row(1, "A", "a", "u"), row(2, "A", None, "u"), row(3, "B", "b", "u"), row(4, "A", "x", "v"), row(5, "B", "x", "w"), row(6, "A", None, "w"), row(7, "C", "c", "z"), row(8, None, "c", "y"), row(9, "C", None, "y"), row(10, None, "n", "u")]
    groups = linked_groups(ingest._link_keys(spark.createDataFrame(rows, ddl)), Passing(spark, "links"))
    assert {r.node: r.root for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 7, 10: 10}


def test_places_near_a_pole_and_in_one_spot_reach_most_tasks(spark):
    """Both were one key of the radius join, so one task of four had all their pairs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        polar = spark.range(500).selectExpr("id", "85 + id % 50 / 10.0D AS lat", "CAST(id * 37 % 360 - 180 AS DOUBLE) AS lng")
        hot = spark.range(20_000).selectExpr("id", "40.7D AS lat", "-74.0D AS lng")
        for rows, lat, n in ((polar, 90.0, 500), (hot, 40.8, 20_000)):
            rows = rows.unionByName(spark.range(2).selectExpr("-1 AS id", "IF(id = 0, double('nan'), 40.7D) AS lat", "IF(id = 1, double('nan'), 1.0D) AS lng"))
            got = places.within(rows, "id", spark.createDataFrame([(1, lat, -74.0), (2, float("nan"), 1.0)], "b long, lat double, lng double"), "b", 400.0)
            assert got.select("id").distinct().count() == got.count() == n
            assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_text_is_lowered_once_for_all_words(spark):
    rows = spark.createDataFrame([("VLSI Intern", None), (None, "Rtos and scada"), ("Intern", "x"), (None, None)], "title string, text string")
    got = disciplines.with_roles(rows, F.col("title"), F.col("text"), "found", "target")
    assert [(r.found, r.target) for r in got.collect()] == [(["computerEngineering"], True), (["embedded", "controls"], False), ([], False), ([], False)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert plan.count("Contains(") <= sum(map(len, disciplines.DISCIPLINES.values()))


def test_a_slice_of_several_files_is_one_batch(spark, tmp_path, monkeypatch):
    """Files of one slice went to two batches, so a key could meet its later event first."""
    events = spark.range(600).selectExpr(
        "id AS event_id", "id * 7919 % 6 AS user_id", "elt(1 + id * 31 % 7 % 4, 'purchase', 'view', 'error', 'click') AS event_type",
        "CAST(timestamp_micros(1704067200000000 + id * 4000000000) AS TIMESTAMP_NTZ) AS ts",
    )
    events.repartition(8, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streams, "_folder", lambda t: str(tmp_path / "stream"))
    agree_on(spark, tmp_path, "queue_scores")
    taken = spark.read.parquet(str(tmp_path / "stream" / "out")).where("cause = 'event'").groupBy("batch").agg(F.min("at"), F.max("at")).orderBy("batch").collect()
    assert len(taken) == streams.SLICES
    assert all(a[2] < b[1] for a, b in zip(taken, taken[1:]))


def test_a_forest_repeats_no_signature_by_tree(spark):
    classes = spark.createDataFrame([(7, 3, bytes(range(256))), (8, 4, bytes(256))], "cid long, size long, signature binary")
    rows = minhash_forest.tree_rows(classes)
    assert rows.columns == ["tree", "upper", "lower", "cid"]
    assert rows.count() == 2 * minhash_forest.TREES
    assert [(r.cid, r.size, r.low0) for r in minhash_forest.class_planes(classes).where("cid = 8").collect()] == [(8, 4, 0)]
