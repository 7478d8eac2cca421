"""Token-ID output as a content-addressed store.

One map pass encodes documents and cuts each id stream into chunks where a
rolling hash of the last 32 ids meets a mask.  The store has four tables:

* ``chunks``: each distinct chunk once, keyed by the SHA-256 of its bytes
  (unsigned little-endian 16-bit ids where all fit, else 32-bit);
* ``recipes``: per document its chunks' keys in order, each with its ids and those
  that follow it, and their Merkle root, in ascending doc_id order across and within the files of each ``part``;
* ``parts``: per part its documents, ids and Merkle root (a tree of 4,096 documents a node);
* ``manifest``: the totals and the root over all parts.

Reading back checks the manifest against the roots of all documents, and each
document's recipe against its root.  It never moves chunk data: each stored chunk
is read once, its hash is verified, and its CRC-32 is taken; only (key, crc,
length) joins the recipes.
CRC-32 is linear over GF(2), so a document's CRC is the XOR of its chunks' CRCs,
each shifted by the bytes that follow it; Spark sums those with ``bit_xor`` and
partial aggregation.  ``reconstruct`` returns the ids themselves.

Encoded documents are written once to the shared folder before they are
deduplicated and sorted, so a lost executor never repeats the tokenizing.  A hot
chunk (a third of all documents being copies) is folded by the partial aggregate
on the way in, and on the way out its join may be split by adaptive execution.

Defined results: a null text is encoded as empty (the end id alone); repeated
doc_ids are separate documents, ordered by their Merkle root; null doc_ids come
first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType

from .common import Scratch, read, ship, write
from .monoid_bpe import load_vocabulary

#: Chunks have this many ids at least and at most, and about MASK + 1 more than the least on average.
MIN_IDS, MAX_IDS, MASK = 64, 1024, 0xFF
CACHE_ENTRIES = 700_000
#: Documents under a node of a part's hash tree.
FAN = 4096
#: Characters of texts that are split by the standard library before the tokenizer sees each piece.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
WITHIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x100)])
ANY_WORD = re.compile(r"[^\t-\r ]+")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9²³¹¼-¾]|[^\t-\r {LETTERS}0-9²³¹¼-¾]+")

#: The normalizer and pre-tokenizer whose texts may be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: In the model's alphabet the bytes that don't print are the characters from U+0100 on, in order; others are themselves.
BYTE_CHARACTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


def beyond(text: str) -> bool:
    """Whether a text has control characters or any that Latin-1 lacks."""
    try:
        return bool(text.encode("latin-1").translate(None, WITHIN))
    except UnicodeEncodeError:
        return True


class WordCodec(dict):
    """Words to packed ids by the tokenizers library; a bounded cache of what it has seen.

    The tokenizer drops white space and encodes each match of its pattern on its
    own, so a text's ids are those of its words, and a word's those of its
    pieces, one after another.  That holds for one normalizer and pre-tokenizer; a
    file with others is encoded text by text.  Texts with characters beyond Latin-1 are parted at
    white space only.  A full cache takes no more words: the frequent come early.
    """

    def __init__(self, data: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        parts = json.loads(data)
        self.by_words = (parts["normalizer"], parts["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)

    def __missing__(self, word: str) -> bytes:
        pieces = PIECES.findall(word)
        if not pieces or not word.isprintable() or not word.isascii() and beyond(word):
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif len(pieces) > 1:
            found = b"".join(map(self.__getitem__, pieces))
        else:  # one match: the model takes its bytes as characters
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
            found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self) < CACHE_ENTRIES and len(word) <= 64:
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if beyond(text):
            words = [w if beyond(w) else w.lower() for w in ANY_WORD.findall(text)]
        else:
            words = text.lower().split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


_CODECS: dict[str, WordCodec] = {}


def word_codec(data: bytes) -> WordCodec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = WordCodec(data)
    return _CODECS[key]


#: One random 32-bit value per id class of the rolling hash; generated, not stored.
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 1 << 16, dtype=np.uint64).astype(np.uint32)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream: content-defined, so equal passages cut alike."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    h = GEAR[ids & 0xFFFF]
    for k in (1, 2, 4, 8, 16):  # doubles the window of the rolling hash up to 32 ids
        h[k:] += h[:-k] << np.uint32(k)
    ends, start = [], 0
    for at in (np.flatnonzero((h & np.uint32(MASK << 20)) == 0) + 1).tolist():
        while at - start > MAX_IDS:
            start += MAX_IDS
            ends.append(start)
        if at - start >= MIN_IDS:
            start = at
            ends.append(at)
    while n - start > MAX_IDS:
        start += MAX_IDS
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def pack(ids: np.ndarray) -> bytes:
    """A chunk's bytes: a width byte, then the ids."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up alone."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# --- CRC-32 of concatenations --------------------------------------------------


def _zero_byte_tables() -> list[np.ndarray]:
    """For k: the effect on a CRC of 2**k zero bytes, as four tables of 256."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    step = np.stack([(v >> 8) ^ table[v & 0xFF] for v in (byte, byte << 8, byte << 16, byte << 24)])
    out = [step]
    for _ in range(47):
        out.append(np.stack([_apply(out[-1], _apply(out[-1], byte << np.uint32(8 * b))) for b in range(4)]))
    return out


def _apply(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    return t[0][v & 0xFF] ^ t[1][(v >> 8) & 0xFF] ^ t[2][(v >> 16) & 0xFF] ^ t[3][v >> 24]


_TABLES: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's CRC adds to the CRC of a whole in which ``n_bytes`` follow the part."""
    if not _TABLES:
        _TABLES.extend(_zero_byte_tables())
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero((n_bytes >> k) & 1)
        crc[on] = _apply(_TABLES[k], crc[on])
    return crc


@F.pandas_udf(LongType())
def shifted(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
    return pd.Series(shift_crc(crc.to_numpy(), n_bytes.to_numpy()).astype(np.int64))


# --- the store -----------------------------------------------------------------

ENCODED = "row_no long, doc_id {key}, n_tokens long, root binary, recipe array<struct<key: binary, n: int, after: long>>, fresh array<struct<key: binary, data: binary>>"


def encode_chunks(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Per document its recipe, and the chunks its task had not met before."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(tokenizer_path))

    def nested(sizes: list[int], **columns: pa.Array) -> pa.Array:
        """A list of structs per document from flat columns."""
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, met = word_codec(vocabulary.value), set()
        end = np.array([end_id], "<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, roots, n_chunks, n_fresh = [], [], [], []
                keys, lengths, afters, new_keys, new_data = [], [], [], [], []
                for x in batch.column(2):
                    ids = np.concatenate([own.encode(x.as_py() or ""), end])
                    ends, start, before, fresh = cut_points(ids), 0, len(keys), len(new_keys)
                    for stop in ends:
                        data = pack(ids[start:stop])
                        key = hashlib.sha256(data).digest()
                        keys.append(key)
                        lengths.append(stop - start)
                        afters.append(len(ids) - stop)
                        if key not in met:
                            if len(met) < CACHE_ENTRIES:
                                met.add(key)
                            new_keys.append(key)
                            new_data.append(data)
                        start = stop
                    sizes.append(len(ids))
                    roots.append(merkle(keys[before:]))
                    n_chunks.append(len(ends))
                    n_fresh.append(len(new_keys) - fresh)
                recipe = nested(n_chunks, key=pa.array(keys, pa.binary()), n=pa.array(lengths, pa.int32()), after=pa.array(afters, pa.int64()))
                fresh_chunks = nested(n_fresh, key=pa.array(new_keys, pa.binary()), data=pa.array(new_data, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(roots, pa.binary()), recipe, fresh_chunks],
                    ["row_no", "doc_id", "n_tokens", "root", "recipe", "fresh"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text").mapInArrow(run, ENCODED.format(key=key))


class ChunkStore:
    """A written store; the tables are lazily read Parquet files."""

    def __init__(self, spark: SparkSession, root: str):
        at = lambda name: spark.read.parquet(f"{root}/{name}")
        self.spark, self.root = spark, root
        self.chunks, self.recipes, self.parts, self.manifest = map(at, ("chunks", "recipes", "parts", "manifest"))

    def verified_chunks(self) -> DataFrame:
        """key, n, crc of every stored chunk; fails on one whose bytes don't have its hash."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, crcs = [], []
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if hashlib.sha256(data).digest() != key:
                        raise ValueError(f"chunk {key.hex()} is damaged")
                    ids = unpack(data)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], ["key", "n", "crc"])

        return self.chunks.select("key", "data").mapInArrow(run, "key binary, n int, crc long")

    def starts(self) -> DataFrame:
        """row_no, start: ids of all documents before each, in ascending doc_id order.

        Parts are few (one per file), so their running totals are summed over one
        small table; within a part a window does it.
        """
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        own = self.recipes.select("row_no", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
        return own.join(F.broadcast(offsets), "part").select("row_no", (F.col("offset") + F.col("within")).alias("start"))

    def verified_recipes(self) -> DataFrame:
        """row_no, key, want, n_bytes: the chunks of every document with their ids and the bytes that follow.

        Fails on a document whose chunks don't have its Merkle root or its number of ids.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, chunks = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten()
                keys, sizes, after = chunks.field("key"), chunks.field("n").to_numpy(), chunks.field("after").to_numpy()
                names, ends = keys.to_pylist(), np.cumsum(counts)
                totals = np.repeat(batch.column(3).to_numpy(), counts)
                before = np.cumsum(sizes) - sizes
                first = np.repeat(ends - counts, counts)
                if (totals - (before - before[first]) - sizes != after).any() or after[ends - 1].any():
                    raise ValueError("a document's chunks don't have its number of ids")
                for start, end, root in zip([0, *ends.tolist()], ends.tolist(), batch.column(2).to_pylist()):
                    if merkle(names[start:end]) != root:
                        raise ValueError("a document's chunks don't have its Merkle root")
                rows = np.repeat(batch.column(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(rows), keys, pa.array(sizes), pa.array(after * 4)], ["row_no", "key", "want", "n_bytes"])

        return self.recipes.select("row_no", "recipe", "root", "n_tokens").mapInArrow(run, "row_no long, key binary, want int, n_bytes long")

    def document_crcs(self) -> DataFrame:
        """row_no, ids_crc32, n_read: from the stored chunks alone."""
        placed = self.verified_recipes()
        met = placed.join(self.verified_chunks(), "key", "left")
        checked = F.when(F.col("crc").isNull() | (F.col("n") != F.col("want")), F.raise_error(F.lit("a recipe's chunk is missing or of another length"))).otherwise(F.col("crc"))
        parts = met.select("row_no", "n", shifted(checked.cast("long"), "n_bytes").alias("crc"))
        return parts.groupBy("row_no").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_read"))

    def read_back(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files; fails if these don't have the manifest's root."""
        if not self.manifest_holds():
            raise ValueError("the documents don't have the manifest's root")
        docs = self.recipes.select("row_no", "doc_id")
        return docs.join(self.starts(), "row_no").join(self.document_crcs(), "row_no").select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")

    def reconstruct(self) -> DataFrame:
        """doc_id and its whole id stream, its Merkle root verified."""

        @F.pandas_udf("array<long>")
        def ids_of(roots: pd.Series, parts: pd.Series) -> pd.Series:
            out = []
            for root, rows in zip(roots, parts):
                rows = sorted(rows, key=lambda r: r["at"])
                if merkle([bytes(r["key"]) for r in rows]) != root:
                    raise ValueError("a document's chunks don't have its Merkle root")
                out.append(np.concatenate([unpack(bytes(r["data"])) for r in rows]).astype(np.int64))
            return pd.Series(out)

        placed = self.recipes.select("row_no", "doc_id", "root", F.posexplode("recipe").alias("at", "r"))
        met = placed.withColumn("key", F.col("r.key")).drop("r").join(self.chunks, "key")
        whole = met.groupBy("row_no", "doc_id", "root").agg(F.collect_list(F.struct("at", "key", "data")).alias("rows"))
        return whole.select("doc_id", ids_of("root", "rows").alias("ids"))

    def manifest_holds(self) -> bool:
        """Whether the manifest's root is that of the recipes as they stand."""
        return parts_of(self.recipes).transform(manifest_of).exceptAll(self.manifest).isEmpty()


def rooted(rows: DataFrame, by: list[str], order: str, root) -> DataFrame:
    """Documents, ids and one hash over the roots of each group, in order."""
    roots = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), root.alias("root")))), lambda x: x.root)
    return rows.groupBy(*by).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(roots, ""), 256).alias("root"))


def parts_of(recipes: DataFrame) -> DataFrame:
    """A hash tree of two levels per part, so that no group has more than ``FAN`` documents or nodes of a file."""
    node = F.expr(f"(nth & {(1 << 33) - 1}) div {FAN}").alias("node")
    leaves = recipes.select("part", node, "nth", "n_tokens", F.lit(1).cast("long").alias("n_docs"), "root")
    return rooted(rooted(leaves, ["part", "node"], "nth", F.hex("root")), ["part"], "node", F.col("root"))


def manifest_of(parts: DataFrame) -> DataFrame:
    """The totals and the root over all parts (a row per file)."""
    roots = F.transform(F.array_sort(F.collect_list(F.struct("part", "root"))), lambda x: x.root)
    return parts.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(roots, ""), 256).alias("root"))


def write_store(docs: DataFrame, root: str, tokenizer_path: str, end_id: int, scratch: Scratch) -> ChunkStore:
    """Encode ``docs`` (doc_id, text) and write the store's tables under ``root``."""
    spark = docs.sparkSession
    ship(spark)
    encoded = scratch.table(encode_chunks(docs, tokenizer_path, end_id), "encoded")
    chunks = encoded.select(F.explode("fresh").alias("f")).select("f.key", "f.data").groupBy("key").agg(F.first("data").alias("data"))
    write(chunks, f"{root}/chunks")
    ordered = encoded.select("row_no", "doc_id", "n_tokens", "root", "recipe").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root", "row_no")
    numbered = ordered.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    write(numbered, f"{root}/recipes")
    recipes = spark.read.parquet(f"{root}/recipes")
    write(parts_of(recipes).coalesce(1), f"{root}/parts")
    write(manifest_of(spark.read.parquet(f"{root}/parts")).coalesce(1), f"{root}/manifest")
    scratch.drop("encoded")
    return ChunkStore(spark, root)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    scratch = Scratch(spark, "chunk-store")
    store = write_store(read(spark, sf_dir, "documents"), scratch.path("store"), public.path("word_bpe_49k.json"), 2, scratch)
    return store.read_back()
