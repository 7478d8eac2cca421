"""The trie of shared conversation prefixes, with subtree totals by leaf-peeling messages.

Nodes are the distinct sequences of first turns.  The steps:

1. Turns are numbered by an ordered scan that splits long conversations over tasks;
   of a turn only a digest of role and text and the text's bytes go on.
2. A second scan folds each conversation's digests to one 127-bit polynomial hash a
   depth (the fold is associative, so a conversation may span tasks).  Depth and hash
   name the node; two different prefixes agree with a probability of about d / 2^127.
3. Grouping by node gives members and smallest member; grouping the nodes by their
   parent gives children and, for each node, the child with most members.
4. The chains of those heavy children are contracted: each becomes one vertex, named
   by the conversation that its leaf is the smallest member of.  A child off its
   parent's chain has at most half of the parent's members, so a path from a leaf up
   crosses at most log2(conversations) chains.
5. Leaf peeling: vertices hold counters of the children that haven't finished.  Those
   at zero send their subtree's totals to their parents and leave; rounds go on
   until the root has finished, so their number is that of step 4, at any depth.
   A round joins only the vertices that remain.
6. The messages are added where they arrived, and an ordered scan along each chain,
   from its leaf up, gives every node its totals.

Nothing but one row a task (the scans' ends) reaches the driver.  The digest of a
node's ends is sequential by nature: ids stream in order, one at a time in memory.

Defined results: turns are ordered by turn (null first), role and text, so ties and
repeated rows have one order; a null role or text is empty; rows without a conv_id
are in no conversation; a conversation without turns is a member of the root only;
an empty table has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import add_states, ordered_scan
from .common import Scratch, read, ship

MODULUS = (1 << 127) - 1
BASE = 0x3A7D_1B59_E2C4_86F0_95D3_7B1E_4C28_A6F5
ROOT = bytes(16)
#: The contract's rebuilt conversations: heads come from the conversation at the group's start.
GROUP, MOST_HEAD = 5, 9
#: No path crosses more chains than a count of conversations has bits.
MAX_ROUNDS = 64


def _lift(digest: bytes) -> tuple[int, bytes, bytes]:
    return 1, (int.from_bytes(digest[:15], "big") + 1).to_bytes(16, "big"), ROOT


def _join(x: tuple, y: tuple) -> tuple[int, bytes, bytes]:
    """Number of turns, hash of all, hash of all but the last, of x's turns followed by y's."""
    shift = pow(BASE, y[0] - 1, MODULUS)
    head = int.from_bytes(x[1], "big")
    before = (head * shift + int.from_bytes(y[2], "big")) % MODULUS
    whole = (head * shift * BASE + int.from_bytes(y[1], "big")) % MODULUS
    return x[0] + y[0], whole.to_bytes(16, "big"), before.to_bytes(16, "big")


def turn_digests(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), digest, n_bytes of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return ordered_scan(rows, "conv_id", ["turn", "role", "text"], [], "pos long", lambda: (1,), add_states, ["conv_id", "digest", "n_bytes"], lambda df: scratch.table(df, "digests"))


def _peeled(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """parent, at, leaves, saved: every message that a chain sends when it has finished.

    ``chains``: chain, parent (null: the root's chain), at, waiting, leaves, saved.
    """
    left = scratch.table(chains, "waiting-0")
    sent: DataFrame | None = None
    for step in range(1, MAX_ROUNDS):
        done = left.where("waiting = 0")
        messages = scratch.table(done.where("parent IS NOT NULL").select("parent", "at", "leaves", "saved"), f"sent-{step}")
        sent = messages if sent is None else sent.unionByName(messages)
        heard = messages.groupBy("parent").agg(F.count("*").alias("n"), F.sum("leaves").alias("more"), F.sum("saved").alias("kept"))
        rest = left.where("waiting > 0").join(heard, F.col("chain") == heard.parent, "left").select(
            "chain", left.parent, "at", (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting"),
            (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("kept", F.lit(0))).alias("saved"),
        )
        left = scratch.table(rest, f"waiting-{step}")
        scratch.drop(f"waiting-{step - 1}")
        if left.isEmpty():
            return sent
    raise RuntimeError(f"chains still wait after {MAX_ROUNDS} rounds")


def _end_digests(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256: the digest of the ids that end at each node; ids stream in order."""
    kind = ends.schema["conv_id"].dataType.simpleString()
    rows = ends.select("depth", "node", F.col("conv_id").cast(kind)).repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if at == (depth, node):
                    digest.update(b",%d" % conv)
                else:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (depth, node), hashlib.sha256(b"%d" % conv)
            yield _columns(out)
        if at is not None:
            yield _columns([(*at, digest.hexdigest())])

    def _columns(out: list[tuple]) -> pa.RecordBatch:
        kinds = (("depth", pa.int64()), ("node", pa.binary()), ("ends_sha256", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return rows.mapInArrow(run, "depth long, node binary, ends_sha256 string")


def prefix_trie(steps: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie's nodes, one row each.

    ``steps``: conv_id, pos, digest, n_bytes of the conversations' turns, positions
    ascending; ``ids``: conv_id of all conversations, turnless ones included.
    """
    ship(steps.sparkSession)
    hashed = ordered_scan(steps, "conv_id", ["pos"], ["digest"], "depth long, node binary, above binary", _lift, _join, ["conv_id", "n_bytes"], lambda df: scratch.table(df, "hashed"))
    lengths = hashed.groupBy("conv_id").agg(F.max("depth").alias("n"))
    top = ids.select("conv_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("above"))
    members = scratch.table(hashed.select(top.columns).unionByName(top), "members")

    counted = members.groupBy("depth", "node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("above").alias("above"), F.max("n_bytes").alias("n_bytes"))
    nodes = scratch.table(counted, "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("node")).agg(
        F.count("*").alias("n_children"), F.max_by("node", F.struct("n_convs", -F.col("conv_id"))).alias("heavy")
    )
    known = scratch.table(nodes.join(kids, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "known")
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"), "heavy")
    placed = known.drop("heavy").join(parents, ["depth", "above"], "left").withColumn("light", ~F.coalesce(F.col("heavy") == F.col("node"), F.lit(False))).drop("heavy")
    placed = scratch.table(placed, "placed")

    # a chain is named by its leaf's smallest member, which passes through all of it
    names = placed.where("n_children = 0").select("conv_id")
    passed = members.select("conv_id", "depth", "node").join(names, "conv_id").withColumnRenamed("conv_id", "chain")
    passed = scratch.table(passed.join(placed, ["depth", "node"]), "passed")
    starts = passed.where("light").groupBy("chain").agg(F.max("depth").alias("start"))
    chained = scratch.table(passed.join(starts, "chain").where("depth >= start").withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")), "chained")

    heads = chained.where("depth = start AND depth > 0").select("chain", (F.col("depth") - 1).alias("depth"), F.col("above").alias("node"))
    above = chained.where("n_children > 1").select("depth", "node", F.col("chain").alias("parent"))
    hung = heads.join(above, ["depth", "node"]).select("chain", "parent", F.col("depth").alias("at"))
    own = chained.groupBy("chain").agg(F.sum("own").alias("saved"), F.sum(F.greatest(F.col("n_children") - 1, F.lit(0))).alias("waiting"))
    chains = own.join(hung, "chain", "left").select("chain", "parent", "at", "waiting", F.lit(1).cast("long").alias("leaves"), "saved")
    messages = _peeled(chains, scratch).groupBy(F.col("parent").alias("chain"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("kept"))

    told = chained.join(messages, ["chain", "depth"], "left").select(
        "chain", "depth", "node", "conv_id", "parent_conv_id", "n_convs", "n_children",
        (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("leaves", F.lit(0))).cast("long").alias("leaves"), (F.col("own") + F.coalesce("kept", F.lit(0))).alias("saved"),
    )
    keep = ["chain", "depth", "node", "conv_id", "parent_conv_id", "n_convs", "n_children"]
    totals = ordered_scan(told, "chain", [F.desc("depth")], ["leaves", "saved"], "n_leaves long, saved_tokens long", lambda a, b: (a, b), add_states, keep, lambda df: scratch.table(df, "totals"))

    last = ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0).cast("long")).alias("depth"))
    ends = members.join(last, ["conv_id", "depth"]).select("conv_id", "depth", "node")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return totals.join(_end_digests(ends), ["depth", "node"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def rebuilt(digests: DataFrame, ids: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % 5, then c's own after its first h."""
    head = F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD
    shape = ids.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = digests.where((F.col("pos") < MOST_HEAD) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes")
    first = shape.join(heads, "base").where("pos <= h").select("conv_id", "pos", "digest", "n_bytes")
    tails = digests.join(shape.select("conv_id", "h"), "conv_id").where("pos > h").select("conv_id", "pos", "digest", "n_bytes")
    return first.unionByName(tails)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the rebuilt conversations' trie."""
    scratch = Scratch(spark, "prefix-trie")
    digests = turn_digests(read(spark, sf_dir, "conversations"), scratch)
    ids = scratch.table(digests.select("conv_id").distinct(), "ids")
    return prefix_trie(rebuilt(digests, ids), ids, scratch)


#: crc32 of the column ``key`` in SQL.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda a, z: xor(a >> 1, 3988292384::UBIGINT * (a & 1)))), 4294967295::UBIGINT)"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, CAST({CRC_SQL} % 9 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS key FROM t)),
built AS (
  SELECT i.conv_id, b.pos, b.role, b.text FROM ids i JOIN t b ON b.conv_id = i.conv_id - i.conv_id % 5 AND b.pos <= i.h
  UNION ALL SELECT i.conv_id, o.pos, o.role, o.text FROM ids i JOIN t o ON o.conv_id = i.conv_id AND o.pos > i.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS n_bytes,
    string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
members AS (
  SELECT conv_id, depth, n_bytes, path FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes FROM members GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, substr(path, 1, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, path)),
totals AS (
  SELECT m.depth, m.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.n_bytes) AS saved
  FROM known k JOIN members m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.depth, m.path),
ends AS (
  SELECT depth, path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n FROM members) WHERE depth = n GROUP BY depth, path)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM known k JOIN totals t USING (depth, path) LEFT JOIN ends e USING (depth, path)
LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.path = substr(k.path, 1, length(k.path) - 64) AND k.depth > 0
"""
