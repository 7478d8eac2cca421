"""N-gram Jaccard join over prefix trees, with exact components.

A document's n-gram set is put in one global order: shingles that are frequent in
the corpus last, the others by hash.  Two sets with Jaccard similarity of at
least t share a shingle among the first ``|S| - ceil(t |S|) + 1`` of each, their
prefixes.  The steps:

1. Count shingles over all documents in map tasks; those counted often become
   the frequent list (at most ``FREQUENT`` entries, a broadcast of fixed size).
   The list only chooses the order, so its bound never loses a link.
2. One row per document: set size, set key and prefix.  Equal sets are one class,
   so copies never meet each other again.
3. A class joins the group of each shingle of its prefix that other classes hold
   too.  The members of a group are stored in a prefix tree, their sets being
   paths in the global order, and probes walk the tree together: a node is entered
   with all probes for which the codes on its path leave the needed overlap in
   reach, so members share the overlap counted on their common path and probes
   share the walk.  Subtrees are pruned by what remains of both sets, by sizes,
   by component and, at a leaf, by the sketches.
4. First walk: classes with many shared shingles join the groups of ``PICKS`` of
   them, chosen by hash, dealt into blocks with the group's plainest member (the
   one with the fewest rarer shingles of its own) in each.  Each takes the plainest
   member if it is in reach, else its best partner.  Those pairs are verified and
   contracted to components, so a group of near copies costs as many pairs as it
   has members.  What this walk misses is left to the next.
5. Second walk, of every group that still spans several components: groups are by
   shingle and pair of neighbouring bands of size, and hold what their members
   have after the shingle, as pairs that share an earlier one are found there.
   Members outside the group's largest component probe.  A large group is dealt
   as a grid, blocks of members by blocks of probes, so no task holds more than
   two blocks of a group.  Sizes, components and sketches meet first, and only
   what they leave a partner is sent with its codes.
6. What is in reach is verified on whole texts, and components are formed from
   all links.  A sketch is one bit of parity for each of 256 parts of a whole set;
   sketches differ in no more bits than their sets do in shingles, so near copies
   of one text that aren't similar enough to each other never become a pair.
   Sets of ``LONG`` shingles or more carry the sizes of those parts too, whose
   differences add up to no more than the sets' own.

Nothing is collected but the frequent list.  Verification sends only the texts
of involved classes, grouped by leader and salted by the leader's degree.

Defined results: null texts and texts without words have an empty set and are
linked with nothing; with fewer words than ``n`` the whole sequence is the one
shingle; repeated rows each get a row; a null doc_id takes part, and counts as
the least id of its component only if no other is there; an empty table gives no
rows; other columns are ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, evict, read, ship
from .components import components

FREQUENT, LOCAL_LEAST, COUNT_BUFFER = 200_000, 4, 2_000_000
#: Groups that a class joins in the first walk, and most members of a block in the first and in the second walk.
PICKS, NEAR_BLOCK, BLOCK = 4, 64, 256
HUB = 100
#: Columns of a set's sketch, 64 bits each.
SKETCH = ["s0", "s1", "s2", "s3"]
LONG = 400
#: Rows of a batch that are Python lists at a time.
SLICE = 256
BROADCAST_ROWS = 100_000
CACHE_ENTRIES = 400_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Words to 8 bytes of hash."""

    def __missing__(self, word: bytes) -> bytes:
        evict(self, CACHE_ENTRIES)
        found = self[word] = hashlib.blake2b(word, digest_size=8).digest()
        return found


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and parted at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(hashes.__getitem__, words)), "<u8")
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * PRIME + w[k : k + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketch(found: np.ndarray) -> np.ndarray:
    """For each of 256 parts of the hash values, whether the set has an odd number there."""
    parity = np.bincount((found & np.uint64(255)).astype(np.intp), minlength=256) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def part_sizes(found: np.ndarray) -> bytes | None:
    """How many shingles of a long set are in each of 256 parts of the hash values, 255 at most."""
    if len(found) < LONG:
        return None
    return np.minimum(np.bincount((found & np.uint64(255)).astype(np.intp), minlength=256), 255).astype(np.uint8).tobytes()


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """The most frequent shingles, ascending by count: an order for step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, total = WordHashes(), [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL_LEAST
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["h", "n"])

        for batch in batches:
            for x in batch.column(0):
                held.append(shingles(x.as_py(), n, hashes))
                total += len(held[-1])
                if total > COUNT_BUFFER:
                    yield counted()
                    held, total = [], 0
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64).copy()


class Order:
    """Shingle hashes to codes whose numerical order is the global order."""

    def __init__(self, frequent: np.ndarray):
        at = np.argsort(frequent)
        self.sorted, self.rank = frequent[at], at.astype(np.int64)

    def codes(self, found: np.ndarray) -> np.ndarray:
        out = (found >> np.uint64(2)).astype(np.int64)
        if len(self.sorted):
            i = np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)
            often = self.sorted[i] == found
            out[often] = (1 << 62) | self.rank[i[often]]
        out.sort()
        return out


def prefix_length(size: int, num: int, den: int) -> int:
    return size + (-num * size // den) + 1 if size else 0


def needed(x: int, y: int, num: int, den: int) -> int:
    """Least overlap of sets of these sizes with den * overlap >= num * union."""
    return -(-num * (x + y) // (num + den))


def document_sets(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, size, key (null if empty), prefix and sketch of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order = WordHashes(), Order(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [shingles(x.as_py(), n, hashes) for x in part.column(1)]
                sizes = [len(f) for f in found]
                keys = [set_key(f) if len(f) else None for f in found]
                prefixes = [order.codes(f)[: prefix_length(len(f), num, den)] for f in found]
                sketches = np.array([sketch(f) for f in found]).reshape(-1, len(SKETCH))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array([part_sizes(f) for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(s, pa.int64()) for s in sketches.T)], ["doc_id", "size", "key", "prefix", "parts", *SKETCH])

    sketched = ", ".join(f"{s} long" for s in SKETCH)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, size long, key binary, prefix array<long>, parts binary, {sketched}")


# --- the prefix tree -----------------------------------------------------------------


#: Parts that a row plays in a group.
MEMBER, PROBE, BOTH = 0, 1, 2


def narrowed(code: int) -> int:
    """31 bits of a code; codes that are equal then count as shared, which only adds candidates."""
    return code & (1 << 30) - 1 | 1 << 30 if code >> 62 else code >> 32


NARROWED = f"(CASE WHEN {{c}} >= {1 << 62} THEN ({{c}} & {(1 << 30) - 1}) | {1 << 30} ELSE shiftright({{c}}, 32) END)"


class Member:
    """A class within a group: its prefix codes that other classes hold too, behind the group's shingle.

    Codes are narrowed to 31 bits, in the same order; ``places`` count all prefix
    codes before each, held by others or not; the prefix has ``length`` codes and
    ends with the code ``last``, which isn't narrowed.  ``place`` is the group's
    shingle's, or -1 where the codes are those of the whole prefix.
    """

    __slots__ = ("after", "comp", "cid", "last", "length", "parts", "place", "places", "role", "size", "sketch")

    def __init__(self, cid: int, comp: int, role: int, size: int, length: int, last: int, place: int, *rest):
        *parity, parts, codes, places = rest
        self.cid, self.comp, self.role, self.size, self.length, self.last = cid, comp, role, size, length, last
        self.place, self.after, self.places = place, codes, places
        self.sketch = int.from_bytes(b"".join(p.to_bytes(8, "little", signed=True) for p in parity), "little")
        self.parts = None if parts is None else np.frombuffer(parts, np.uint8).astype(np.int16)

    def room(self, i: int) -> int:
        """At most so many shingles stand behind the first ``i`` codes."""
        return self.size - 1 - (self.places[i - 1] if i else self.place)


class Node:
    """An inner node of the tree: set sizes below it, the most that any set has left here, and the component if all have one."""

    __slots__ = ("children", "comp", "ends", "least", "most", "room")

    def __init__(self) -> None:
        self.children: dict[int, Node | Member] = {}
        self.ends: list[Member] = []
        self.least, self.most, self.room = 1 << 62, 0, 0
        self.comp: int | None = None

    def widen(self, m: Member, depth: int) -> None:
        self.comp = m.comp if not self.most or self.comp == m.comp else None
        self.least, self.most, self.room = min(self.least, m.size), max(self.most, m.size), max(self.room, m.room(depth))


def plant(members: list[Member]) -> Node:
    """The tree of the members' codes; a path without forks is kept as its member."""
    root = Node()
    for m in members:
        node, depth = root, 0
        while True:
            node.widen(m, depth)
            if depth == len(m.after):
                node.ends.append(m)
                break
            code = m.after[depth]
            depth += 1
            below = node.children.get(code)
            if below is None:
                node.children[code] = m
                break
            if isinstance(below, Member):  # the path forks: the sitting member goes one level down
                fork = node.children[code] = Node()
                fork.widen(below, depth)
                if depth == len(below.after):
                    fork.ends.append(below)
                else:
                    fork.children[below.after[depth]] = below
                below = fork
            node = below
    return root


def reach(x: Member, y: Member, i: int, j: int, shared: int, num: int, den: int) -> int:
    """Codes that x and y share if they can reach the needed overlap, else 0; codes are compared from i and j on."""
    if x.comp == y.comp or num * x.size > den * y.size or num * y.size > den * x.size:
        return 0
    a, b = x.after, y.after
    need = needed(x.size, y.size, num, den)
    apart = x.size + y.size - 2 * need
    if (x.sketch ^ y.sketch).bit_count() > apart:
        return 0
    if shared + min(x.room(i), y.room(j)) < need:
        return 0
    if x.parts is not None and y.parts is not None and int(np.abs(x.parts - y.parts).sum()) > apart:
        return 0
    while i < len(a) and j < len(b):
        if shared + min(x.room(i), y.room(j)) < need:
            return 0
        if a[i] == b[j]:
            shared += 1
            i += 1
            j += 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    # up to the end of the shorter prefix everything is known, beyond it nothing; narrowed codes may tie there
    end = min(x.last, y.last)
    known = narrowed(end)
    while i < len(a) and a[i] < known:
        i += 1
    while j < len(b) and b[j] < known:
        j += 1
    left_x = x.size - x.length if x.last == end else x.room(i)
    left_y = y.size - y.length if y.last == end else y.room(j)
    return shared if shared + min(left_x, left_y) >= need else 0


def hopeful(members: list[Member], num: int, den: int) -> list[Member]:
    """Members and probes that sizes, components and sketches leave some partner; all at once, by the group's matrix."""
    probes = [m for m in members if m.role != MEMBER]
    stored = [m for m in members if m.role != PROBE]
    if len(probes) * len(stored) < 50:
        return members
    sizes, comps = (tuple(np.array([getattr(m, what) for m in side], np.int64) for side in (probes, stored)) for what in ("size", "comp"))
    bits = [np.frombuffer(b"".join(m.sketch.to_bytes(32, "little") for m in side), np.uint64).reshape(-1, 4) for side in (probes, stored)]
    x, y = sizes[0][:, None], sizes[1][None, :]
    apart = x + y + 2 * (-num * (x + y) // (num + den))
    differ = np.bitwise_count(bits[0][:, None, :] ^ bits[1][None, :, :]).sum(axis=2, dtype=np.int64)
    fit = (differ <= apart) & (comps[0][:, None] != comps[1][None, :]) & (num * x <= den * y) & (num * y <= den * x)
    left = {id(m) for side, some in ((probes, fit.any(axis=1)), (stored, fit.any(axis=0))) for m, ok in zip(side, some.tolist()) if ok}
    return [m for m in members if id(m) in left]


def partnered(sent: DataFrame, key: list[str], num: int, den: int) -> DataFrame:
    """The rows of ``sent`` that sizes, components and sketches leave some partner in their group (equal ``key``), without these.

    Rows are compared with those 1, 2, ... places behind them, all groups of a batch
    at once; only a batch's last, unfinished group is carried on.
    """
    kept = [*key, "cid", "comp", "role", "place"]
    rows = sent.select(*kept, "size", "parts", *SKETCH).repartition(*key).sortWithinPartitions(*key)

    def fitting(batch: pa.RecordBatch, ends: np.ndarray) -> np.ndarray:
        """Which rows have a partner; ``ends``: where each row's group ends."""
        comp, role, size = (batch.column(c).to_numpy() for c in ("comp", "role", "size"))
        bits = np.stack([batch.column(s).to_numpy() for s in SKETCH], axis=1).view(np.uint64)
        long = batch.column("parts").is_valid().to_numpy(zero_copy_only=False)
        parts = np.frombuffer(b"".join(batch.column("parts").drop_null().to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
        nth = np.cumsum(long) - 1
        fit = np.zeros(len(ends), bool)
        left, step = np.arange(len(ends)), 1
        while len(left := left[left + step < ends[left]]):
            i, j = left, left + step
            x, y = size[i], size[j]
            met = (comp[i] != comp[j]) & ((role[i] != role[j]) | (role[i] == BOTH)) & (num * x <= den * y) & (num * y <= den * x)
            i, j, both = i[met], j[met], (x + y)[met]
            apart = both + 2 * (-num * both // (num + den))
            near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= apart
            known = np.flatnonzero(near & long[i] & long[j])
            near[known] = np.abs(parts[nth[i[known]]] - parts[nth[j[known]]]).sum(axis=1, dtype=np.int64) <= apart[known]
            fit[i[near]] = fit[j[near]] = True
            step += 1
        return fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(last: bool) -> pa.RecordBatch:
            """The rows with partners of all groups held, but for the last one unless it is finished."""
            whole = pa.concat_batches(held)
            keys = np.stack([whole.column(k).to_numpy() for k in key], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            done = whole.num_rows if last else int(starts[-1])
            held[:] = [whole.slice(done)]
            ends = np.repeat(np.r_[starts[1:], whole.num_rows], np.diff(np.r_[starts, whole.num_rows]))
            ready = whole.slice(0, done)
            return ready.select(kept).filter(pa.array(fitting(ready, ends[:done])))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield settled(False)
        if held:
            yield settled(True)

    kinds = dict(rows.select(kept).dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept))


def leaves(below: Node) -> Iterator[Member]:
    """All members of a subtree."""
    stack: list[Node | Member] = [below]
    while stack:
        node = stack.pop()
        if isinstance(node, Member):
            yield node
        else:
            yield from node.ends
            stack.extend(node.children.values())


def traverse(root: Node, probes: list[Member], num: int, den: int, met: int) -> Iterator[tuple[Member, Member, int]]:
    """Pairs of a probe and a member of another component within reach, with the codes they share.

    One walk serves all probes, each with its place among its codes and what it
    shares with the path; ``met`` shingles are known to be shared.
    """
    stack: list[tuple[Node, int, list[tuple[Member, int, int]]]] = [(root, 0, [(x, 0, met) for x in probes])]
    while stack:
        node, depth, alive = stack.pop()
        near = []
        for x, i, shared in alive:
            size = x.size
            if node.comp == x.comp or num * size > den * node.most or num * node.least > den * size:
                continue  # of one component, or sizes alone are too far apart
            if shared + min(x.room(i), node.room) >= needed(size, max(node.least, -(-num * size // den)), num, den):
                near.append((x, i, shared))
        if not near:
            continue
        for y in node.ends:
            for x, i, shared in near:
                if found := reach(x, y, i, depth, shared, num, den):
                    yield x, y, found
        for code, below in node.children.items():
            if isinstance(below, Member):
                for x, i, shared in near:
                    if found := reach(x, below, i, depth, shared, num, den):
                        yield x, below, found
                continue
            down = []
            for x, i, shared in near:
                a = x.after
                while i < len(a) and a[i] < code:
                    i += 1
                if i == len(a):  # x's prefix ends here; what x holds beyond it may still match
                    for y in leaves(below):
                        if found := reach(x, y, i, depth, shared, num, den):
                            yield x, y, found
                elif a[i] == code:
                    down.append((x, i + 1, shared + 1))
                else:
                    down.append((x, i, shared))
            if down:
                stack.append((below, depth + 1, down))


def walked(sent: DataFrame, key: list[str], num: int, den: int, found) -> DataFrame:
    """a, b: the pairs that ``found(members)`` yields for each group of rows with equal keys; a group is held at a time.

    The other columns are those of ``Member``.
    """
    width = len(key)
    columns = ["cid", "comp", "role", "size", "length", "last", "place", *SKETCH, "parts", "codes"]
    rows = sent.select(*key, *columns).repartition(*key).sortWithinPartitions(*key)

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
        """The rows, with codes and places as lists of their own."""
        packed = batch.column(batch.num_columns - 1)
        both = packed.flatten().to_numpy()
        codes, places = (both >> 32).tolist(), (both & 0xFFFFFFFF).tolist()
        ends = np.cumsum(packed.value_lengths().to_numpy()).tolist()
        for row, start, end in zip(zip(*(c.to_pylist() for c in batch.columns[:-1])), [0, *ends], ends):
            yield (*row, codes[start:end], places[start:end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
            out.clear()
            return done

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                for row in unpacked(whole.slice(at, SLICE)):
                    if group != row[:width]:
                        if len(held) > 1:
                            for pair in found(hopeful([Member(*m) for m in held], num, den)):
                                out.append(pair)
                                if len(out) > 10_000:
                                    yield flush()
                        group, held = row[:width], []
                    held.append(row[width:])
        if len(held) > 1:
            for pair in found(hopeful([Member(*m) for m in held], num, den)):
                out.append(pair)
                if len(out) > 10_000:
                    yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(run, "a long, b long").distinct()


def held_codes(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class with a shared prefix shingle: those codes, each packed with its place, and what bounds need."""
    found = shared.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("t", "place"))).alias("held"))
    packed = F.expr(f"transform(held, h -> shiftleft({NARROWED.format(c='h.t')}, 32) | h.place)")
    return found.select("cid", packed.alias("codes")).join(classes.select("cid", "size", "length", "last", "parts", *SKETCH), "cid")


def first_walk(held: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: for each class with many shared shingles a partner within reach, if it meets one; a is the plainest member if that is it."""
    many = held.where(4 * F.size("codes") >= F.col("length"))
    chosen = F.slice(F.array_sort(F.expr("transform(codes, c -> struct(xxhash64(shiftright(c, 32)) AS h, c))")), 1, PICKS)
    picks = many.select("cid", F.explode(chosen).alias("p")).selectExpr("cid", "shiftright(p.c, 32) AS t", "p.c & 4294967295 AS rarer")
    plain = F.min_by("cid", F.struct("rarer", F.xxhash64("cid"))).alias("leader")
    sizes = picks.groupBy("t").agg(F.ceil(F.count("*") / NEAR_BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"), plain).where("n > 1").drop("n")
    dealt = picks.join(sizes, "t").withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).where("cid <> leader").select("t", "side", "cid", F.lit(BOTH).alias("role"))
    leaders = sizes.select("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("side"), F.col("leader").alias("cid"), F.lit(MEMBER).alias("role"))
    sent = dealt.unionByName(leaders).join(held, "cid").withColumn("comp", F.col("cid")).withColumn("place", F.lit(-1))

    def found(members: list[Member]) -> Iterator[tuple[int, int]]:
        best: dict[int, tuple] = {}
        for x, y, shared in traverse(plant(members), [m for m in members if m.role == BOTH], num, den, 0):
            best[x.cid] = max(best.get(x.cid, (False, 0, 0)), (y.role == MEMBER, shared, -y.cid))
        for cid, (leads, _, other) in best.items():
            yield (-other, cid) if leads else (min(-other, cid), max(-other, cid))

    return walked(sent, ["t", "side"], num, den, found)


def second_walk(shared: DataFrame, held: DataFrame, stars: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """a, b: all pairs of classes in different components that share a prefix shingle and are within reach.

    Sizes fall into bands about as wide as the similarity allows them to differ,
    so partners are in one band or in neighbours; a pair belongs to the group of
    its upper band.
    """
    wide = max(math.log(den / num), 1e-9) * (1 + 1e-6)
    labelled = shared.join(stars, F.col("cid") == F.col("node"), "left").select("t", "cid", "size", "place", F.coalesce("root", "cid").alias("comp"))
    banded = labelled.withColumn("band", F.floor(F.log("size") / wide).cast("int")).withColumn("g", F.explode(F.array("band", F.col("band") + 1)))
    opened = banded.groupBy("t", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least"), F.max("band").alias("top")).where("lo <> hi AND top = g").select("t", "g", "least")
    # the least partner that sizes allow, and what must be shared with it
    partner = F.expr(f"greatest(least, ({num} * size + {den - 1}) div {den})")
    room = F.expr(f"({num} * (size + partner) + {num + den - 1}) div {num + den}")
    rows = banded.join(opened, ["t", "g"]).withColumn("partner", partner).where(F.col("size") - F.col("place") >= room)
    rows = scratch.table(rows.select("t", "g", "cid", "comp", "place"), "opened")
    parts = rows.groupBy("t", "g", "comp").agg(F.count("*").alias("n")).groupBy("t", "g").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("most < n")
    grid = parts.select("t", "g", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("chunks"))
    dealt = rows.join(grid, ["t", "g"]).withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int"))
    cell = lambda side, chunk, role: F.struct(side.alias("side"), chunk.alias("chunk"), role.alias("role"))
    probes = F.col("comp") != F.col("main")
    as_member = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: cell(F.col("side"), c, F.lit(MEMBER)))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(b, F.col("chunk"), F.lit(PROBE)))
    alone = F.array(cell(F.lit(0), F.lit(0), F.when(probes, BOTH).otherwise(MEMBER)))
    cells = F.when((F.col("blocks") == 1) & (F.col("chunks") == 1), alone).when(probes, F.concat(as_member, as_probe)).otherwise(as_member)
    celled = dealt.select("t", "g", "cid", "comp", "place", F.explode(cells).alias("cell")).select("t", "g", "cid", "comp", "place", "cell.*")
    group = ["t", "g", "side", "chunk"]
    sent = partnered(celled.join(held.select("cid", "size", "parts", *SKETCH), "cid"), group, num, den).join(held, "cid")
    at = F.expr(f"array_position(codes, shiftleft({NARROWED.format(c='t')}, 32) | place)")
    sent = sent.withColumn("codes", F.when(at < F.size("codes"), F.slice("codes", at + 1, F.size("codes"))).otherwise(F.array().cast("array<long>")))

    def found(members: list[Member]) -> Iterator[tuple[int, int]]:
        for x, y, _ in traverse(plant([m for m in members if m.role != PROBE]), [m for m in members if m.role != MEMBER], num, den, 1):
            yield (min(x.cid, y.cid), max(x.cid, y.cid))

    return walked(sent, group, num, den, found)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar; a is the hub of its pairs."""
    pairs = scratch.table(pairs.select("a", "b"), f"{name}-pairs")
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts"))
    salted = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    own = classes.select("cid", "key", F.col("doc_id").alias("rep"))
    spokes = salted.select("a", "salt", F.lit(1).alias("spoke"), F.col("b").alias("cid"))
    hubs = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("spoke"), F.col("a").alias("cid"))
    wanted = scratch.table(spokes.unionByName(hubs).join(own, "cid"), f"{name}-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))
    rows = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "spoke").select("a", "salt", "spoke", "cid", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, hub = WordHashes(), None, None
        for batch in batches:
            left, right = [], []
            for row, (a, salt, spoke, cid, key) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
                found = shingles(batch.column(5)[row].as_py(), n, hashes)
                if set_key(found) != key:
                    continue  # another text under the same doc_id
                if not spoke:
                    at, hub = (a, salt), found
                elif at == (a, salt):
                    overlap = len(np.intersect1d(hub, found, assume_unique=True))
                    if den * overlap >= num * (len(hub) + len(found) - overlap):
                        left.append(a)
                        right.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return scratch.table(rows.mapInArrow(run, "a long, b long").distinct(), f"{name}-links")


def jaccard_components(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id, key: documents linked at Jaccard >= num/den over word n-grams."""
    ship(docs.sparkSession)
    frequent = frequent_shingles(docs, n)
    sets = scratch.table(document_sets(docs, n, num, den, frequent), "sets")
    grouped = sets.where("size > 0").groupBy("key", "size", "prefix", *SKETCH).agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"))
    lengths = grouped.withColumn("length", F.size("prefix")).withColumn("last", F.element_at("prefix", -1))
    classes = scratch.table(lengths.withColumn("cid", F.monotonically_increasing_id()), "classes")
    tokens = classes.select("cid", "size", F.posexplode("prefix").alias("place", "t"))
    groups = tokens.groupBy("t").agg(F.count("*").alias("members")).where("members > 1").select("t")
    shared = scratch.table(tokens.join(groups, "t"), "shared")
    held = scratch.table(held_codes(shared, classes), "held")
    links = verified(first_walk(held, num, den), classes, docs, n, num, den, scratch, "near")
    stars = components(links, scratch, "first")
    more = verified(second_walk(shared, held, stars, num, den, scratch), classes, docs, n, num, den, scratch, "rest")
    for name in ("shared", "held", "opened"):
        scratch.drop(name)
    joined = links.unionByName(more)
    roots = components(joined, scratch, "all") if not more.isEmpty() else stars
    placed = classes.select("cid", "key", "doc_id").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = placed.select("key", "root").join(least, "root").select("key", "component_id")
    return sets.select("doc_id", F.col("size").alias("n_shingles"), "key").join(by_key, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "key"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, 3, 9, 10, Scratch(spark, "prefix-tree")).drop("key")
