"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document: a segment holds whole documents of about
``SEGMENT_WORDS`` words, and for every term of them the sorted list of its
positions (counted over the segment, documents being ``GAP`` apart).  It is one
Parquet table, a row per segment, written once to the shared folder and usable
for any later benchmark.  Building is one map pass; nothing is shuffled.

Matching counts the benchmark's terms over the whole index, orders every test
window's terms from the rarest, and in each segment intersects the
offset-adjusted lists in that order, so most windows end at a short or missing
first list.  What is left after the last list is an exact phrase match: all of a
window's words stand at their places, so no text is read again.  A document's
lists lie in one segment, hence intersecting needs no shuffle; only hits are
shuffled, to be merged per document.  Test windows are broadcast in blocks of at
most ``BLOCK_WINDOWS``, so that a benchmark of any size, and an item of any length, is
matched in rounds; what is broadcast (a block's terms, windows and owners) is
bounded by that figure.  Tasks cut the items into windows; the driver sees a block at a time.

``proximity_matches`` finds the places where an item's rarest terms stand close together.

Defined results: null texts and texts without words have no words and no hits;
items without words match nothing; an item of fewer words than a window is one
window; repeated documents or items are judged separately, and equal item_ids
count once; empty tables give rows without hits or no rows; other columns are
ignored.  A document longer than a segment is a segment of its own, and a segment
has at most ``SEGMENT_DOCUMENTS``, so positions stay within 31 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, ship

WINDOW_WORDS = 10
SEGMENT_WORDS, SEGMENT_DOCUMENTS = 400_000, 100_000
GAP = 1_000
BLOCK_WINDOWS = 200_000
MAX_ITEM_WORDS = 1 << 30
#: A segment is a row of megabytes.  Parquet looks at sizes only every hundred rows by itself, and a reader takes
#: thousands of rows of a row group at once; with small row groups a task holds a few segments, however many it has.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
#: Bytes other than those of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` become spaces, A-Z become a-z.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def build_index(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """The segments of ``docs`` (doc_id, text); ``written_index`` writes them before use.

    Rows are numbered by ``row``.  Without it they get numbers that hold only
    within the written index, as another scan of ``docs`` may number them otherwise.
    """
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row_nos array<long>, doc_ids array<{key}>, starts array<int>, sizes array<int>, terms array<string>, counts array<int>, steps binary"
    names = ["row_nos", "doc_ids", "starts", "sizes", "terms", "counts", "steps"]

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, rows, keys, sizes, total, key_type = _Numbers(), [], [], [], [], 0, None

        def segment() -> pa.RecordBatch:
            n = np.array(sizes, np.int64)
            starts = np.concatenate([[0], np.cumsum(n + GAP)[:-1]])
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            term = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            both = np.sort((term.astype(np.int64) << 32) | at)
            counts = np.bincount(term, minlength=len(numbers)).astype(np.int32)
            steps = (both & 0xFFFFFFFF).astype(np.int32)
            firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
            head = steps[firsts]
            steps[1:] -= steps[:-1].copy()  # differences compress better than positions
            steps[firsts] = head
            columns = [pa.array(rows, pa.int64()), pa.array(keys, key_type), pa.array(starts, pa.int32()), pa.array(n, pa.int32()), pa.array([t.decode() for t in numbers], pa.string()), pa.array(counts)]
            return pa.RecordBatch.from_arrays([*map(one, columns), pa.array([steps.tobytes()], pa.binary())], names)

        for batch in batches:
            key_type = batch.column(1).type
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                if rows and (total + len(words) > SEGMENT_WORDS or len(rows) == SEGMENT_DOCUMENTS):
                    yield segment()
                    numbers, ids, rows, keys, sizes, total = _Numbers(), [], [], [], [], 0
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                rows.append(row)
                keys.append(doc)
                sizes.append(len(words))
                total += len(words)
        if rows:
            yield segment()

    return docs.select((F.monotonically_increasing_id() if row is None else row).alias("row_no"), "doc_id", "text").mapInArrow(run, schema)


def written_index(docs: DataFrame, scratch: Scratch, name: str, row: Column | None = None) -> DataFrame:
    """The index of ``docs`` as a table of few segments a row group."""
    return scratch.table(build_index(docs, row), name, "zstd", ROW_GROUPS)


def directory(index: DataFrame) -> DataFrame:
    """row_no, doc_id, n_words of every indexed document."""
    return index.select(F.explode(F.arrays_zip("row_nos", "doc_ids", "sizes")).alias("d")).select(
        F.col("d.row_nos").alias("row_no"), F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words")
    )


def term_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Occurrences in the whole index of the given terms (a benchmark's, one block at a time)."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    found = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    return {r["term"]: r["n"] for r in found.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def item_windows(text: str | None, size: int = WINDOW_WORDS) -> Iterator[tuple[str, ...]]:
    """The windows of an item (maybe repeated)."""
    words = [w.decode() for w in words_of(text)]
    for k in range(max(1, len(words) - size + 1) if words else 0):
        yield tuple(words[k : k + size])


class Lists:
    """The posting lists of one segment."""

    def __init__(self, terms: list[str], counts: np.ndarray, steps: np.ndarray):
        self.slot = {t: i for i, t in enumerate(terms)}
        self.ends = np.cumsum(counts)
        self.counts, self.steps = counts, steps

    def __contains__(self, term: str) -> bool:
        return term in self.slot

    def positions(self, term: str) -> np.ndarray:
        i = self.slot[term]
        return np.cumsum(self.steps[self.ends[i] - self.counts[i] : self.ends[i]].astype(np.int64))


def phrase_starts(lists: Lists, ordered: list[tuple[str, int]], known: dict[str, np.ndarray]) -> np.ndarray:
    """Where all (term, offset) stand together; the rarest term comes first."""
    at = None
    for term, offset in ordered:
        if term not in lists:
            return np.zeros(0, np.int64)
        if term not in known:
            known[term] = lists.positions(term)
        here = known[term]
        if at is None:
            at = here - offset
        else:
            i = np.searchsorted(here, at + offset)
            at = at[(i < len(here)) & (here[np.minimum(i, len(here) - 1)] == at + offset)]
        if not len(at):
            break
    return at


def near_positions(lists: Lists, terms: list[str], slop: int) -> np.ndarray:
    """Positions of the first term with every other term within ``slop`` words."""
    if any(t not in lists for t in terms):
        return np.zeros(0, np.int64)
    at = lists.positions(terms[0])
    for t in terms[1:]:
        here = lists.positions(t)
        i = np.searchsorted(here, at - slop)
        at = at[(i < len(here)) & (here[np.minimum(i, len(here) - 1)] <= at + slop)]
    return at


def _search(index: DataFrame, plan: list, find) -> DataFrame:
    """row_no, what, start, length: ``find(lists, plan)`` gives (what, positions, length) for a segment."""
    sent = index.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, starts, terms, counts = (batch.column(i)[k].values for i in range(4))
                rows, starts = rows.to_numpy(), starts.to_numpy()
                lists = Lists(terms.to_pylist(), counts.to_numpy(), np.frombuffer(batch.column(4)[k].as_buffer(), np.int32))
                found = list(find(lists, sent.value))
                if found:
                    at = np.concatenate([f[1] for f in found])
                    each = [len(f[1]) for f in found]
                    doc = np.searchsorted(starts, at, side="right") - 1
                    columns = [rows[doc], np.repeat([f[0] for f in found], each), at - starts[doc], np.repeat([f[2] for f in found], each)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row_no", "what", "start", "length"])

    return index.select("row_nos", "starts", "terms", "counts", "steps").mapInArrow(run, "row_no long, what long, start long, length long")


def _find_phrases(lists: Lists, plan: list) -> Iterator[tuple[int, np.ndarray, int]]:
    known: dict[str, np.ndarray] = {}
    for anchor, windows in plan:
        if anchor in lists:
            for number, ordered in windows:
                at = phrase_starts(lists, ordered, known)
                if len(at):
                    yield number, at, len(ordered)


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item_id, window: the distinct windows of the items, words parted by spaces."""
    ship(items.sparkSession)
    key = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cut = [], []
            for row, text in enumerate(batch.column(1)):
                for window in item_windows(text.as_py(), size):
                    owner.append(row)
                    cut.append(" ".join(window))
                    if len(cut) == 10_000:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(cut)], ["item_id", "window"])
                        owner, cut = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(cut, pa.string())], ["item_id", "window"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {key}, window string").distinct()


def _blocks(items: DataFrame, size: int) -> Iterator[dict[tuple[str, ...], list]]:
    """Distinct windows with their item_ids, in blocks that stream through the driver."""
    block: dict[tuple[str, ...], list] = defaultdict(list)
    held = 0
    for row in windows_of(items, size).toLocalIterator():
        block[tuple(row["window"].split(" "))].append(row["item_id"])
        held += 1
        if held >= BLOCK_WINDOWS:
            yield block
            block, held = defaultdict(list), 0
    if block:
        yield block


def phrase_matches(index: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """row_no, item_id, start, length: every occurrence of every item window."""
    spark = index.sparkSession
    key = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in _blocks(items, size):
        counts = term_counts(index, sorted({t for w in block for t in w}))
        plan, by_anchor, owners = [], defaultdict(list), []
        for number, (window, ids) in enumerate(sorted(block.items())):
            if all(t in counts for t in window):
                ordered = sorted(((t, i) for i, t in enumerate(window)), key=lambda x: (counts[x[0]], x))
                by_anchor[ordered[0][0]].append((number, ordered))
                owners += [(number, i) for i in ids]
        plan = sorted(by_anchor.items())
        owner = spark.createDataFrame(owners, f"what long, item_id {key}")
        found = _search(index, plan, _find_phrases).join(F.broadcast(owner), "what").drop("what")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"row_no long, item_id {key}, start long, length long")
    return out.select("row_no", "item_id", "start", "length")


def proximity_matches(index: DataFrame, items: DataFrame, n_terms: int = 3, slop: int = 20) -> DataFrame:
    """row_no, item_id, start: where an item's ``n_terms`` rarest terms stand within ``slop`` words (under GAP) of the rarest."""
    spark = index.sparkSession
    key = items.schema["item_id"].dataType.simpleString()
    if slop >= GAP:
        raise ValueError(f"slop must be under {GAP}, the distance of documents")

    def find(lists: Lists, plan: list) -> Iterator[tuple[int, np.ndarray, int]]:
        for number, terms in plan:
            at = near_positions(lists, terms, slop)
            if len(at):
                yield number, at, 1

    out = None
    for block in _blocks(items, MAX_ITEM_WORDS):
        counts = term_counts(index, sorted({t for w in block for t in w}))
        plan, owners = [], []
        for number, (words, ids) in enumerate(sorted(block.items())):
            terms = sorted(set(words), key=lambda t: (counts.get(t, 0), t))[:n_terms]
            plan.append((number, terms))
            owners += [(number, i) for i in ids]
        found = _search(index, plan, find).join(F.broadcast(spark.createDataFrame(owners, f"what long, item_id {key}")), "what").drop("what")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"row_no long, item_id {key}, start long, length long")
    return out.select("row_no", "item_id", "start")


def contamination(index: DataFrame, items: DataFrame, scratch: Scratch, size: int = WINDOW_WORDS) -> DataFrame:
    """row_no, doc_id, n_words, n_hit, item_ids for every indexed document; the hits are written once."""
    hits = scratch.table(phrase_matches(index, items, size), "hits")
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("row_no").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row_no", "start", "length").distinct().withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = spans.groupBy("row_no").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).alias("n_hit"))
    owners = hits.groupBy("row_no").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    found = directory(index).join(covered, "row_no", "left").join(owners, "row_no", "left")
    return found.select("row_no", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.array_sort("item_ids"), F.array().cast("array<string>")).alias("item_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "positional-index")
    index = written_index(read(spark, sf_dir, "documents"), scratch, "segments")
    found = contamination(index, read(spark, sf_dir, "benchmark"), scratch)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, array_to_string(words[i:i+9], ' ') AS g, least(len(words), 10) AS size
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM bw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bg),
dg AS (
  SELECT r, i, s.size, array_to_string(words[i:i+s.size-1], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM dw), sizes s WHERE i + s.size - 1 <= len(words)),
hits AS (SELECT r, i, dg.size, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.size = bg.size),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
own AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN own USING (r)
"""
