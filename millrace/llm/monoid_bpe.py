"""Byte-level BPE by monoid tree reduction.

Encodings form a monoid: the join of two encodings is the encoding of the joined
bytes.  ``TreeBPE.encode`` splits a piece in halves recursively and joins the two
results.  A join re-encodes a window of tokens around the boundary and grows it
until the token pairs at both window edges are stable.  A pair (a, b) is stable
when encoding its bytes alone gives (a, b) again.  A token sequence is the BPE
encoding of its bytes exactly when all its adjacent pairs are stable (each merge
joins the lowest-ranked adjacent pair, so an encoding differs from a sequence of
whole tokens only if some merge crosses one of its boundaries, and the first one
to cross shows already in the pair alone).  So no token outside the window can
change.  Decoding concatenates token bytes up the same tree.

Texts are split by the tokenizer's pattern first, each match being encoded on
its own; matches meet at stable boundaries by definition, so the upper part of
the tree is plain concatenation.  One map pass, no shuffle; the vocabulary (under
a stated size) is broadcast.

Defined results: null and empty texts have no tokens; special-token strings are
ordinary text; repeated rows each get a row; an empty table gives none; columns
other than the key and text are ignored.  Workers keep bounded caches of pieces
and pairs; emptied caches only cost time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read, ship

MAX_VOCABULARY_BYTES = 64 << 20
CACHE_ENTRIES = 500_000
#: Texts of these characters alone are split by the standard library, which is faster.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
BEYOND_LATIN = re.compile("[^\t-\r -ſ]")
SPLIT_LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{NUMBER}]+| ?[^{SPACE}{LATIN}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


class TreeBPE:
    """Encoder and decoder over a table of token bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Plain BPE of a short window: always the lowest-ranked pair, leftmost first."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if n > 64:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        scores = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while scores:
            found = [s for s in scores if s is not None]
            if not found:
                break
            i = scores.index(min(found))
            parts[i] += parts.pop(i + 1)
            scores.pop(i)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1])
        return tuple(ranks[p] for p in parts)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for windows that grew long, with a heap and linked neighbours."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # a part starts at i and ends at end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two parts has changed since
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def stable(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both byte strings together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j, name = len(left) - 1, 1, self.bytes_of
        while True:
            window = self.merge(b"".join([name[t] for t in left[i:]] + [name[t] for t in right[:j]]))
            fits_left = i == 0 or self.stable(left[i - 1], window[0])
            fits_right = j == len(right) or self.stable(window[-1], right[j])
            if fits_left and fits_right:
                return left[:i] + window + right[j:]
            grow = len(left) - i + j
            if not fits_left:
                i = max(0, i - grow)
            if not fits_right:
                j = min(len(right), j + grow)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Halve, encode both halves, join."""
        if len(piece) <= 1:
            return (self.ranks[piece],) if piece else ()
        known = self.memo.get(piece)
        if known is None:
            half = len(piece) // 2
            known = self.join(self.encode(piece[:half]), self.encode(piece[half:]))
            if len(piece) <= 32:
                if len(self.memo) > CACHE_ENTRIES:
                    self.memo.clear()
                self.memo[piece] = known
        return known

    def decode(self, ids: list[int]) -> bytes:
        """Concatenate up a tree of blocks."""
        name = self.bytes_of
        parts = [b"".join(map(name.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


class TextCodec(dict):
    """Pieces of text to ids; a dictionary that encodes what it misses."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.bpe = TreeBPE(ranks)
        self.split = regex.compile(pattern).findall
        self.text_of = {i: str(i) for i in self.bpe.bytes_of}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        ids = self.bpe.encode(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return self.split(text) if BEYOND_LATIN.search(text) else SPLIT_LATIN.findall(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_CODECS: dict[tuple[str, str], TextCodec] = {}


def codec(data: bytes, pattern: str) -> TextCodec:
    """The worker's codec for a vocabulary; built once per process."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = TextCodec(read_ranks(data), pattern)
    return _CODECS[key]


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes")
    return data


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for x in batch.column(1):
                ids = own.encode(x.as_py() or "")
                shown = " ".join(map(own.text_of.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(own.bpe.decode(ids)).hexdigest(), ids if with_ids else None))
            columns = list(zip(*rows)) or [(), (), (), ()]
            out = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(columns[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, vocabulary_path: str, pattern: str = "") -> DataFrame:
    """doc_id and decoded bytes of an ``ids`` column."""
    spark = encoded.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value, pattern).bpe
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["doc_id", "decoded"])

    key = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, decoded binary")


def query(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers as public

    return encode_documents(read(spark, sf_dir, "documents") if docs is None else docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
