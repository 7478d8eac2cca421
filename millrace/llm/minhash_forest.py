"""Near-duplicates by an LSH forest of minhash signatures, with exact links.

1. One pass over the texts gives each document's set of word shingles: its size and
   key, ``TREES`` x ``DEEP`` minhash values of 16 bits, and what exact bounds need (parities and counts of
   ``PARTS`` parts of the set).
   Equal sets are one class, so copies never meet each other again.
2. Each tree is the order of the classes by its own ``DEEP`` values.  A region of a
   tree is a run of classes with a common prefix; its depth adapts to the data: it
   starts at ``DEPTHS[0]`` and grows where a region has more than ``REGION`` classes.
   Two classes of a region are neighbours by longest common prefix.  Pairs of Jaccard
   similarity 0.8 share a region of depth 3 in one of 16 trees with probability
   0.99999, of depth 4 with 0.9998.  Regions still larger at the last depth hold near
   copies; they are dealt out as a grid of blocks.
3. In a region all pairs of rows are looked at as two bits of each minhash value, a
   vector at a time and within the task.  A pair stays where sizes allow it and at
   most ``APART`` of 128 values differ (at 0.8 more differ once in a million pairs).
4. First round: a class takes its region's leader (the class of the lowest hash, so
   that trees agree on it) if that stays, else its best neighbour; at most two over
   all trees.  Those are confirmed on whole sets and contracted to components, so a
   group of near copies costs as many pairs as it has members.
5. Joining rounds: in regions that span several components, each component takes the
   best pair that leaves it, of those that the exact bounds by sketches of whole sets
   allow.  Those pairs are confirmed and contracted in turn, until a round joins nothing
   or ``ROUNDS`` are over.
6. Last round: in the regions that still span several components, every pair that the
   bounds allow and that is of different components is confirmed on whole sets, and
   components are formed from all links.

Every link is confirmed on the whole sets, and no region, partner list or candidate
list is cut short.  Nothing is collected; what reaches the driver is counts.

Defined results: null texts and texts without words have an empty set and are linked
with nothing; with fewer words than ``n`` the whole sequence is the one shingle;
repeated rows each get a row; a null doc_id takes part, and counts as the least id of
its component only if no other is there; an empty table gives no rows; other columns
are ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .components import components
from .prefix_tree_join import BOTH, BROADCAST_ROWS, LONG, MEMBER, PROBE, WordHashes, set_key, shingles, verified

TREES, DEEP = 16, 8
HASHES = TREES * DEEP
DEPTHS = (3, 4, 5, 6, 8)
REGION = 2048
#: Joining rounds at most; what they don't join is left to the last round.
ROUNDS = 1
#: Most of the 128 values that may differ, as two bits, at Jaccard 0.8: expected 19, deviation 4.
APART = 40
#: Parts of the hash values for exact bounds.
PARTS = 1024
#: The 128 low bits and the 128 next bits of a signature's values.
PLANES = ["low0", "low1", "high0", "high1"]
SHINGLES_AT_ONCE, ROWS_AT_ONCE = 2048, 4096

_SEEDS = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, (2, HASHES), np.uint64)
FACTORS, OFFSETS = _SEEDS[0] | np.uint64(1), _SEEDS[1]
_MIX = np.uint64(0xD6E8FEB86659FD93)


def signature(found: np.ndarray) -> np.ndarray:
    """The minhash values of a set as 128 numbers of 16 bits; zeros for an empty set."""
    if not len(found):
        return np.zeros(HASHES, np.uint16)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        np.minimum(least, (found[at : at + SHINGLES_AT_ONCE, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return ((least ^ (least >> np.uint64(31))) * _MIX >> np.uint64(48)).astype(np.uint16)


def sketches_of(found: np.ndarray) -> tuple[bytes, bytes | None]:
    """For each of ``PARTS`` parts of the hash values: whether the set has an odd number there, and for long sets how many, 15 at most."""
    counts = np.bincount((found & np.uint64(PARTS - 1)).astype(np.intp), minlength=PARTS)
    parity = np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()
    if len(found) < LONG:
        return parity, None
    few = np.minimum(counts, 15).astype(np.uint8)
    return parity, (few[::2] | few[1::2] << 4).tobytes()


def planes(signatures: np.ndarray) -> np.ndarray:
    """Rows of ``PLANES``: the two low bits of every value."""
    bits = [np.packbits(((signatures >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64) for b in (0, 1)]
    return np.concatenate(bits, axis=1)


def document_signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size, key (null if empty), signature, and parity and parts for exact bounds."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(x.as_py(), n, hashes) for x in part.column(1)]
                bounds = [sketches_of(f) for f in found]
                columns = [
                    part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([set_key(f) if len(f) else None for f in found], pa.binary()),
                    pa.array([signature(f).astype(">u2").tobytes() for f in found], pa.binary()), *(pa.array(b, pa.binary()) for b in zip(*bounds)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "key", "signature", "parity", "parts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, size long, key binary, signature binary, parity binary, parts binary")


def tree_rows(classes: DataFrame) -> DataFrame:
    """tree, upper, lower (a tree's eight values as two numbers, in order), cid: a row for each class and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u2").reshape(-1, HASHES)
                halves = np.ascontiguousarray(found).view(">i8").astype(np.int64).reshape(-1, TREES, 2)
                trees = pa.array(np.tile(np.arange(TREES, dtype=np.int32), part.num_rows))
                cids = pa.array(np.repeat(part.column(0).to_numpy(), TREES))
                yield pa.RecordBatch.from_arrays([trees, pa.array(halves[:, :, 0].ravel()), pa.array(halves[:, :, 1].ravel()), cids], ["tree", "upper", "lower", "cid"])

    return classes.select("cid", "signature").mapInArrow(run, "tree int, upper long, lower long, cid long")


def class_planes(classes: DataFrame) -> DataFrame:
    """cid, size, planes: a row for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                bits = planes(np.frombuffer(b"".join(part.column(2).to_pylist()), ">u2").reshape(-1, HASHES).astype(np.uint16))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], ["cid", "size", *PLANES])

    return classes.select("cid", "size", "signature").mapInArrow(run, f"cid long, size long, {', '.join(f'{p} long' for p in PLANES)}")


def prefix_hash(depth: int) -> Column:
    """A number for a tree's prefix of so many values."""
    upper = F.shiftrightunsigned("upper", 16 * max(4 - depth, 0))
    return F.xxhash64("tree", F.lit(depth), upper, F.shiftrightunsigned("lower", 16 * (8 - depth)) if depth > 4 else F.lit(0))


def regions(rows: DataFrame, bits: DataFrame, scratch: Scratch) -> DataFrame:
    """region, n (its classes), cid, size, planes: the rows with neighbours, at the depth of their region.

    Regions are met by their numbers alone; sizes and planes join the rows that stay.
    """
    pieces = []
    left = rows
    for depth in DEPTHS:
        keyed = left.withColumn("region", prefix_hash(depth))
        sizes = scratch.table(keyed.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{depth}")
        fits = F.lit(True) if depth == DEPTHS[-1] else F.col("n") <= REGION
        pieces.append(scratch.table(keyed.join(sizes.where(fits), "region").select("region", "n", "cid"), f"regions-{depth}"))
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        left = scratch.table(keyed.join(large, "region", "left_semi").drop("region"), f"deeper-{depth}")
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return scratch.table(out.join(bits, "cid").select("region", "n", "cid", "size", *PLANES), "regions")


def _stepped(rows: DataFrame, key: list[str], extra: list[str], num: int, den: int, schema: str, made, bounded: bool = False) -> DataFrame:
    """``made(columns, ends, pairs)`` for whole groups of rows with equal ``key``.

    ``pairs`` yields (i, j, how many values differ) as arrays, for rows 1, 2, ...
    places apart in all groups of a batch at once, where sizes and signatures leave
    the pair, and, if ``bounded``, the exact bounds and components do; no row is twice in
    an i, or twice in a j.  Only a batch's last, unfinished group is carried on.
    """
    columns = [*key, "cid", "size", *extra, *PLANES, *(["parity", "parts"] if bounded else [])]
    sorted_rows = rows.select(*columns).repartition(*key).sortWithinPartitions(*key)

    def pairs(c: dict[str, np.ndarray], bits: np.ndarray, ends: np.ndarray, exact) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = c["size"]
        left, step = np.arange(len(ends)), 1
        while len(left := left[left + step < ends[left]]):
            i, j = left, left + step
            fit = (num * size[i] <= den * size[j]) & (num * size[j] <= den * size[i])
            if bounded:
                fit &= (c["comp"][i] != c["comp"][j]) & ((c["role"][i] != c["role"][j]) | (c["role"][i] == BOTH))
            i, j = i[fit], j[fit]
            x = bits[i] ^ bits[j]
            differ = np.bitwise_count(x[:, :2] | x[:, 2:]).sum(axis=1, dtype=np.int64)
            near = differ <= APART
            i, j, differ = i[near], j[near], differ[near]
            if bounded and len(i):
                near = exact(i, j, size)
                i, j, differ = i[near], j[near], differ[near]
            if len(i):
                yield i, j, differ
            step += 1

    def sketches(ready: pa.RecordBatch):
        """The exact bounds: parities and part sizes differ no more than sets that are similar enough."""
        parity = np.frombuffer(b"".join(ready.column("parity").to_pylist()), np.uint64).reshape(-1, PARTS // 64)
        long = ready.column("parts").is_valid().to_numpy(zero_copy_only=False)
        packed = np.frombuffer(b"".join(ready.column("parts").drop_null().to_pylist()), np.uint8).reshape(-1, PARTS // 2)
        low, high = (packed & 15).astype(np.int8), (packed >> 4).astype(np.int8)
        nth = np.cumsum(long) - 1

        def exact(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
            both = size[i] + size[j]
            apart = both + 2 * (-num * both // (num + den))
            near = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64) <= apart
            known = np.flatnonzero(near & long[i] & long[j])
            for at in range(0, len(known), 1024):
                some = known[at : at + 1024]
                x, y = nth[i[some]], nth[j[some]]
                near[some] = sum(np.abs(half[x] - half[y]).sum(axis=1, dtype=np.int64) for half in (low, high)) <= apart[some]
            return near

        return exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.concat_batches(held)
            keys = np.stack([whole.column(k).to_numpy() for k in key], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            done = whole.num_rows if last else int(starts[-1])
            held[:] = [whole.slice(done)]
            if not done:
                return
            ends = np.repeat(np.r_[starts[1:], whole.num_rows], np.diff(np.r_[starts, whole.num_rows]))[:done]
            ready = whole.slice(0, done)
            c = {name: ready.column(name).to_numpy(zero_copy_only=False) for name in [*key, "cid", "size", *extra]}
            bits = np.stack([ready.column(p).to_numpy() for p in PLANES], axis=1).view(np.uint64)
            yield from made(c, ends, pairs(c, bits, ends, sketches(ready) if bounded else None))

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                held.append(part)
                rows_held += part.num_rows
                if rows_held >= ROWS_AT_ONCE:
                    yield from settled(False)
                    rows_held = sum(h.num_rows for h in held)
        if held:
            yield from settled(True)

    return sorted_rows.mapInArrow(run, schema)


def first_round(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, differ: for each class b of a cell that has near ones its leader, if that is near, else its nearest."""
    blocks = F.ceil(F.col("n") / REGION).cast("int")
    dealt = rows.select("region", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("side"), "cid", "size", *PLANES, F.lit(False).alias("leads"))
    large = rows.where(f"n > {REGION}")
    chosen = large.groupBy("region").agg(F.min_by("cid", F.xxhash64("cid")).alias("cid"))
    copies = large.join(chosen, ["region", "cid"]).select(
        "region", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("side"), "cid", "size", *PLANES, F.lit(True).alias("leads")
    )
    hashed = dealt.unionByName(copies).withColumn("rank", F.when(F.col("leads"), F.lit(-(1 << 63)).cast("long")).otherwise(F.xxhash64("cid")))

    def made(c: dict[str, np.ndarray], ends: np.ndarray, pairs: Iterator) -> Iterator[pa.RecordBatch]:
        n = len(ends)
        group = np.cumsum(np.r_[True, ends[1:] != ends[:-1]]) - 1
        by_rank = np.lexsort((c["rank"], group))
        heads = by_rank[np.r_[True, group[by_rank][1:] != group[by_rank][:-1]]]
        leader = heads[group]
        best, partner = np.full(n, APART + 1), np.full(n, -1)
        for i, j, differ in pairs:
            for x, y in ((i, j), (j, i)):
                value = np.where(leader[x] == y, -1, differ)  # the leader comes before all others
                better = (value < best[x]) & (c["cid"][x] != c["cid"][y])
                best[x[better]], partner[x[better]] = value[better], y[better]
        found = np.flatnonzero(partner >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(c["cid"][partner[found]]), pa.array(c["cid"][found]), pa.array(np.maximum(best[found], 0))], ["a", "b", "differ"])

    return _stepped(hashed, ["region", "side"], ["rank"], num, den, "a long, b long, differ long", made)


def at_most_two(met: DataFrame) -> DataFrame:
    """a, b: of a class's partners over all trees the nearest and the one of the lowest hash; the lower hash leads a pair."""
    few = met.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("best"), F.min_by("a", F.xxhash64("a")).alias("lead"))
    both = few.select(F.explode(F.array_distinct(F.array("best", "lead"))).alias("a"), "b")
    return both.select(F.when(F.xxhash64("a") <= F.xxhash64("b"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.xxhash64("a") <= F.xxhash64("b"), F.col("b")).otherwise(F.col("a")).alias("y")).distinct().toDF("a", "b")


def mixed_regions(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """The rows of regions that span several components, with comp."""
    labelled = rows.join(stars, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cid")).drop("node", "root")
    several = labelled.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("region")
    return labelled.join(several, "region")


def cells(mixed: DataFrame) -> DataFrame:
    """``mixed`` dealt out by region, side and chunk, with role; a region of up to ``REGION`` rows is one cell.

    In a larger one the rows outside its largest component probe all blocks of members.
    """
    columns = [c for c in mixed.columns if c != "n"]
    small = mixed.where(f"n <= {REGION}").select(*columns, F.lit(0).alias("side"), F.lit(0).alias("chunk"), F.lit(BOTH).alias("role"))
    large = mixed.where(f"n > {REGION}")
    per_comp = large.groupBy("region", "comp").agg(F.count("*").alias("k")).groupBy("region").agg(F.max("k").alias("most"), F.max_by("comp", F.struct("k", "comp")).alias("main"))
    dealt = large.join(per_comp, "region").withColumn("blocks", F.ceil(F.col("n") / REGION).cast("int")).withColumn("chunks", F.ceil((F.col("n") - F.col("most")) / REGION).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("share", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int"))
    cell = lambda side, chunk, role: F.struct(side.alias("side"), chunk.alias("chunk"), F.lit(role).alias("role"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: cell(F.col("own"), k, MEMBER))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(b, F.col("share"), PROBE))
    cut = dealt.withColumn("cell", F.explode(F.when(F.col("comp") != F.col("main"), F.concat(as_member, as_probe)).otherwise(as_member)))
    return small.unionByName(cut.select(*columns, "cell.*"))


def joining_round(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: for each component of a cell the best pair that leaves it."""

    def made(c: dict[str, np.ndarray], ends: np.ndarray, pairs: Iterator) -> Iterator[pa.RecordBatch]:
        cid = c["cid"]
        _, local = np.unique(np.stack([ends, c["comp"]], axis=1), axis=0, return_inverse=True)
        local = local.ravel()
        best = np.full(local.max() + 1, np.iinfo(np.int64).max)
        x, y = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        for i, j, differ in pairs:
            for side in (local[i], local[j]):
                np.minimum.at(best, side, differ * len(ends) + i)
                won = best[side] == differ * len(ends) + i
                x[side[won]], y[side[won]] = cid[i[won]], cid[j[won]]
        found = best < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[found]), pa.array(np.maximum(x, y)[found])], ["a", "b"])

    return _stepped(cells(mixed), ["region", "side", "chunk"], ["comp", "role"], num, den, "a long, b long", made, True).distinct()


def last_round(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: all pairs of different components that the bounds allow within a cell."""

    def made(c: dict[str, np.ndarray], ends: np.ndarray, pairs: Iterator) -> Iterator[pa.RecordBatch]:
        for i, j, _ in pairs:
            x, y = c["cid"][i], c["cid"][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return _stepped(cells(mixed), ["region", "side", "chunk"], ["comp", "role"], num, den, "a long, b long", made, True).distinct()


def near_duplicates(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id, key: documents linked at Jaccard >= num/den over word n-grams.

    ``APART`` is set for similarities of 0.8 or more.
    """
    if 5 * num < 4 * den:
        raise ValueError("the forest's bound on signatures is for similarities of 0.8 or more")
    ship(docs.sparkSession)
    sets = scratch.table(document_signatures(docs, n), "sets")
    grouped = sets.where("size > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("size", "signature", "parity", "parts")))
    classes = scratch.table(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    near = regions(scratch.table(tree_rows(classes), "trees"), class_planes(classes), scratch)
    scratch.drop("trees")
    met = scratch.table(first_round(near, num, den), "met")
    # only classes with a near one in some cell are ever confirmed; their texts are gathered once
    active = met.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(near.where(f"n > {REGION}").select("cid")).distinct()
    reps = scratch.table(active.join(classes, "cid").select(F.col("doc_id").alias("rep")).distinct(), "active")
    small = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps
    docs = scratch.table(docs.select("doc_id", "text").join(small, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi"), "texts")
    links = verified(at_most_two(met), classes, docs, n, num, den, scratch, "first")
    roots = components(links, scratch, "first-stars")
    sketches = classes.select("cid", "parity", "parts")
    left = scratch.table(mixed_regions(near, roots).drop("comp").join(sketches, "cid"), "mixed")
    for step in range(ROUNDS):
        mixed = scratch.table(mixed_regions(left, roots), f"mixed-{step}")
        more = verified(joining_round(mixed, num, den), classes, docs, n, num, den, scratch, f"round-{step}")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        roots = components(links, scratch, f"stars-{step}")
    mixed = scratch.table(mixed_regions(left, roots), "mixed-last")
    more = verified(last_round(mixed, num, den), classes, docs, n, num, den, scratch, "last")
    if not more.isEmpty():
        roots = components(links.unionByName(more), scratch, "all-stars")
    placed = classes.select("cid", "key", "doc_id").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = placed.select("key", "root").join(least, "root").select("key", "component_id")
    return sets.select("doc_id", F.col("size").alias("n_shingles"), "key").join(by_key, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "key"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, 2, 4, 5, Scratch(spark, "minhash-forest"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
