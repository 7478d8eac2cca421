"""Tampered stores, crowds of empty texts, long items, written ledgers and templates of any form."""

import hashlib
import json

import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import chat_template, chunk_store, positional_index, rule_ledger
from millrace.llm.common import Scratch, read, write

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    scratch = Scratch(spark, "test-store")
    return chunk_store.write_store(read(spark, SMALL, "documents"), scratch.path("store"), public.path("word_bpe_49k.json"), 2, scratch)


def altered(spark, store, **tables):
    """The store with some tables replaced."""
    root = Scratch(spark, "test-altered").path("store")
    for name in ("chunks", "recipes", "parts", "manifest"):
        write(tables.get(name, getattr(store, name)), f"{root}/{name}")
    return chunk_store.ChunkStore(spark, root)


def test_whole_store_equals_the_library(spark, store):
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in read(spark, SMALL, "documents").collect()}
    assert {r.doc_id: list(r.ids) for r in store.reconstruct().collect()} == want
    start = 0
    for r in store.read_back().orderBy("doc_id").collect():
        data = b"".join(i.to_bytes(4, "little") for i in want[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), __import__("zlib").crc32(data))
        start += r.n_tokens


@pytest.mark.parametrize("change", ["reverse(recipe)", "slice(recipe, 1, greatest(size(recipe) - 1, 1))", "transform(recipe, r -> named_struct('key', r.key, 'n', r.n, 'after', r.after + 1))"])
def test_tampered_recipes_are_found(spark, store, change):
    assert store.recipes.where("size(recipe) > 1").count() > 20
    with pytest.raises(Exception, match="chunks don't have its"):
        altered(spark, store, recipes=store.recipes.withColumn("recipe", F.expr(change))).read_back().collect()


def test_tampered_roots_parts_and_manifest_are_found(spark, store):
    lost = store.recipes.where(F.col("doc_id") > 0)
    swapped = store.recipes.withColumn("root", F.when(F.col("doc_id") == 5, F.unhex(F.lit("00"))).otherwise(F.col("root")))
    for tables in ({"recipes": lost}, {"recipes": swapped}, {"manifest": store.manifest.withColumn("n_tokens", F.col("n_tokens") + 1)}):
        with pytest.raises(ValueError, match="manifest"):
            altered(spark, store, **tables).read_back()


def test_another_tokenizer_is_not_cut_by_words():
    data = json.loads(open(public.path("word_bpe_49k.json")).read())
    data["normalizer"] = None
    codec = chunk_store.WordCodec(json.dumps(data).encode())
    text = "Hello  World, HELLO"
    assert codec.encode(text).tolist() == Tokenizer.from_str(json.dumps(data)).encode(text, add_special_tokens=False).ids
    assert not codec.by_words


def test_millions_of_empty_texts(spark):
    docs = spark.range(0, 2_300_000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 2_299_999, "a b").alias("text"))
    scratch = Scratch(spark, "test")
    index = scratch.table(positional_index.build_index(docs), "index")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r) for r in positional_index.phrase_matches(index, items).join(positional_index.directory(index), "row_no").select("doc_id", "start").collect()] == [(2_299_999, 0)]
    assert positional_index.directory(index).count() == 2_300_000
    scratch.drop()


def test_item_of_many_words_comes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(positional_index, "BLOCK_WINDOWS", 20_000)
    long = " ".join(f"w{k}" for k in range(50_000))
    items = spark.createDataFrame([(1, long), (2, "w7 w8")], "item_id long, text string")
    sizes = [len(b) for b in positional_index._blocks(items, 10)]
    assert max(sizes) <= 20_000 and sum(sizes) == 50_000 - 9 + 1
    docs = spark.createDataFrame([(5, " ".join(f"w{k}" for k in range(40, 60)))], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    found = positional_index.contamination(scratch.table(positional_index.build_index(docs), "i"), items, scratch).first()
    assert (found.n_hit, found.item_ids) == (20, ["1"])


def test_slop_beyond_the_gap_is_refused(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(ValueError):
        positional_index.proximity_matches(items, items, 2, positional_index.GAP)


def test_ledger_is_read_as_written(spark):
    scratch = Scratch(spark, "test")
    rows = rule_ledger.write_ledger(read(spark, SMALL, "documents"), scratch)
    assert rows.inputFiles() and rule_ledger.current(rows).count() == 200
    with pytest.raises(Exception, match="other rules"):
        rule_ledger.current(rows.withColumn("ledger_version", F.lit(0))).select(F.sum("fail_bits")).collect()


def test_templates_of_any_form(spark):
    source = (
        "{% set greeting = 'Hi' %}{{ greeting }}{% if messages %}:{% endif %}"
        "{% for m in messages %}{% if m.role == 'a' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}[{{ m.text|escape }}]{% endif %}{% endfor %}"
        "{% for m in messages %}{{ loop.index0 }}{% endfor %}"
    )
    rows = [(1, 1, "a", "yes"), (1, 0, "u", "q"), (2, 0, "u", None), (None, 0, "a", "x"), (3, 0, "a", "s"), (3, 0, "a", "s")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string").repartition(3)
    got = {r.conv_id: (r.piece, [tuple(s) for s in r.spans]) for r in chat_template.format_turns(turns, source).collect()}
    assert got == {1: ("Hi:[q]yes01", [(6, 9)]), 2: ("Hi:[]0", []), None: ("Hi:x0", [(3, 4)]), 3: ("Hi:ss01", [(3, 4), (4, 5)])}
    assert chat_template.format_turns(turns.where("false"), source).count() == 0
    framed = "{% if true and messages %}{% endif %}" + chat_template.CHAT
    whole, each = (chat_template.digest(chat_template.format_turns(turns, t)).select("conv_id", "turns_sha256", "loss_sha256") for t in (framed, chat_template.CHAT))
    assert sorted(map(str, whole.collect())) == sorted(map(str, each.collect()))
    assert hashlib.sha256(b"").hexdigest() in str(whole.collect())
