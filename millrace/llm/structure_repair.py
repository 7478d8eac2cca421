"""Repair of conversations by weighted finite-state composition.

The input acceptor has a state before and after each row; a row's symbol is its role's
initial and its first fault.  The edit transducer has one state and the arcs of
``Edits``: keep, rerole, delete, insert.  The acceptor of ``Grammar`` says which role
initials a repaired conversation may have.  Their composition has states (place,
grammar state) and is expanded lazily, from the states that are reached only.  Its
topological order goes by place, and within a place by the inserts; weights are
(cost, label string), compared in that order, concatenated along a path.  The shortest
path is found from the end of the order: at a state the arcs have different labels
(the grammar allows one role to rerole to or insert), so equal costs are decided by the
first labels and a string is its label and a link to the rest.  No string is copied.

As Spark jobs: an ordered scan numbers the rows, earlier rows with the same role and
text are found by one aggregate, and rows are dealt out as blocks of at most ``BLOCK``
rows.  A conversation that fits in its block is solved there.  A block of a longer one
yields the matrix of least costs between its entry and exit states; a conversation's
matrices (one row a block) are multiplied from the end, which gives each block the
weights beyond it; blocks are solved again from every entry state, and the entry states
are followed from the start.  So a conversation with any share of the rows is spread
over tasks, and a task holds a block at a time.  Only the SHA-256 of a whole repaired
conversation, and its audit as one value, follow the conversation in order: they are
sequential by nature, and stream.

Defined results: a null role or text is one space, and so is a null conv_id or turn
where rows are chosen for damage; rows without a conv_id are one conversation; rows are
ordered by turn (null first), role and text, as damaged, so ties have one order and
repeated rows are adjacent; of equal rows all but the first are duplicates; a role that
is empty or has another initial can't be kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import ordered_scan
from .common import Scratch, read, ship
from .prefix_trie import CRC_SQL

BLOCK = 4096
SPACES = "\t\n\x0b\f\r "
ENDS = ".!?"
BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"
DAMAGE = 20


@dataclass(frozen=True)
class Grammar:
    """An acceptor of role initials; states are numbers, ``arcs[state]`` maps initials to states."""

    arcs: tuple[dict[str, int], ...]
    accepting: frozenset[int]


#: (s?(ua)+)?
CHAT = Grammar(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), frozenset({0, 3}))


@dataclass(frozen=True)
class Edits:
    """The costs of the edit transducer's arcs, and the roles that it can give."""

    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    roles: tuple[str, ...] = ("user", "assistant")


class Composition:
    """Input, edits and grammar composed lazily: arcs are made when a state is reached first."""

    def __init__(self, grammar: Grammar, edits: Edits):
        if edits.insert <= 0:
            raise ValueError("an insert must cost something")
        if any(sum(r[:1] in arcs for r in edits.roles) > 1 for arcs in grammar.arcs):
            raise ValueError("a grammar state must allow one of the roles at most")
        self.grammar, self.edits = grammar, edits
        self._arcs: dict[tuple[str, str, int], list[tuple[int, str, int, str | None]]] = {}

    def arcs(self, initial: str, fault: str, state: int) -> list[tuple[int, str, int, str | None]]:
        """(cost, label, next grammar state, new role) of the arcs that consume a row."""
        key = (initial, fault, state)
        found = self._arcs.get(key)
        if found is None:
            e, allowed = self.edits, self.grammar.arcs[state]
            found = [(e.delete, "D", state, None)]
            if fault not in (BLANK, DUPLICATE):
                more = e.truncated if fault == TRUNCATED else 0
                if initial in allowed:
                    found.append((e.keep + more, "K", allowed[initial], None))
                found += [(e.rerole + more, "R", allowed[r[0]], r) for r in e.roles if r[0] in allowed]
            if len(self._arcs) < 100_000:
                self._arcs[key] = found
        return found

    def inserts(self, state: int) -> list[tuple[int, str, int, str | None]]:
        allowed = self.grammar.arcs[state]
        return [(self.edits.insert, "I", allowed[r[0]], r) for r in self.edits.roles if r[0] in allowed]

    def solve(self, rows: list[tuple[str, str]], entries: Iterable[int], exits: dict[int, int], closing: bool) -> list[dict[int, tuple]]:
        """For each place, the reached states' best arcs: (cost to go, label, new role, next state, whether it consumes).

        ``exits`` has the costs beyond the last row, where only a ``closing`` block may insert.
        """
        reached, now = [], set(entries)
        for i in range(len(rows) + 1):
            if i < len(rows) or closing:
                todo = list(now)
                while todo:
                    for _, _, to, _ in self.inserts(todo.pop()):
                        if to not in now:
                            now.add(to)
                            todo.append(to)
            reached.append(now)
            if i < len(rows):
                now = {to for state in now for _, _, to, _ in self.arcs(*rows[i], state)}
        best: list[dict[int, tuple]] = [{} for _ in reached]
        for i in range(len(rows), -1, -1):
            here = best[i]
            if i == len(rows):
                here.update((s, (exits[s], "", None, s, False)) for s in reached[i] if s in exits)
            else:
                beyond = best[i + 1]
                for s in reached[i]:
                    some = [(c + beyond[to][0], label, to, role) for c, label, to, role in self.arcs(*rows[i], s) if to in beyond]
                    if some:
                        c, label, to, role = min(some, key=lambda x: x[:2])
                        here[s] = (c, label, role, to, True)
            changed = i < len(rows) or closing
            while changed:
                changed = False
                for s in reached[i]:
                    for c, label, to, role in self.inserts(s):
                        if to in here and (s not in here or (c + here[to][0], label) < here[s][:2]):
                            here[s] = (c + here[to][0], label, role, to, False)
                            changed = True
        return best

    @staticmethod
    def path(best: list[dict[int, tuple]], entry: int) -> tuple[str, list[tuple[int, str, str | None, list[str]]], int]:
        """Labels, (place, label, new role, roles inserted before) for each row and a last one for the end, and the exit state."""
        labels, out, before, state, i = [], [], [], entry, 0
        while True:
            _, label, role, to, consumes = best[i][state]
            if not label:
                break
            labels.append(label)
            state = to
            if consumes:
                out.append((i, label, role, before))
                before, i = [], i + 1
            else:
                before.append(role)
        if before:
            out.append((i, "", None, before))
        return "".join(labels), out, state


# --- Spark -------------------------------------------------------------------------------

_EDIT = pa.struct([("pos", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), ("before", pa.list_(pa.string()))])
_EDITS = "array<struct<pos: bigint, edit: string, new_role: string, before: array<string>>>"


def _lift(initial: str) -> tuple[int, str | None, str]:
    return 1, None, initial


def _join(x: tuple, y: tuple) -> tuple[int, str | None, str]:
    """Number of rows, the initial before the last, the last initial."""
    return x[0] + y[0], y[1] if y[0] > 1 else x[2], y[2]


def symbols(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows by place (conv_id, turn, role, text, pos), and without texts as symbols (conv_id, pos, turn, initial, prior, fault).

    Null roles and texts count as one space; ``prior`` is the initial of the row before.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("initial", F.substring("role", 1, 1))
    placed = ordered_scan(
        rows, "conv_id", ["turn", "role", "text"], ["initial"], "pos long, prior string, final string", _lift, _join,
        ["conv_id", "turn", "role", "text"], lambda df: scratch.table(df, "rows"),
    )
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise("")
    light = placed.select("conv_id", "pos", "turn", F.col("final").alias("initial"), "prior", fault.alias("fault"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"))
    light = scratch.table(light, "light")
    seen = light.where(F.col("fault") != BLANK).groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = light.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    found = again.select("conv_id", "pos", "turn", "initial", "prior", fault.alias("fault"))
    return placed.select("conv_id", "turn", "role", "text", "pos"), scratch.table(found, "symbols")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The runs of rows with equal first ``width`` columns, and their other columns."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:width] != at:
                yield at, held
                held = []
            at = row[:width]
            held.append(row[width:])
    if held:
        yield at, held


def edits_of(symbols: DataFrame, scratch: Scratch, grammar: Grammar = CHAT, edits: Edits = Edits()) -> DataFrame:  # noqa: B008
    """conv_id, block, labels, cost (to go, from this block on), edits: the cheapest edits of every block of rows."""
    ship(symbols.sparkSession)
    kind = symbols.schema["conv_id"].dataType.simpleString()
    key_type = pa.int64() if kind == "bigint" else None
    everywhere = range(len(grammar.arcs))
    block = F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("block")
    rows = symbols.select("conv_id", block, "pos", "initial", "fault")

    def listed(composition: Composition, rows: list[tuple], best: list[dict], entry: int) -> tuple[str, int, list[dict], int]:
        labels, path, out = composition.path(best, entry)
        after = rows[-1][0] + 1
        found = [{"pos": rows[i][0] if i < len(rows) else after, "edit": e, "new_role": r, "before": b} for i, e, r, b in path]
        return labels, best[0][entry][0], found, out

    def one_by_one(items: Iterator[tuple], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for item, n in items:
            held.append(item)
            weight += n
            if weight >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(types)], names)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(types)], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        composition = Composition(grammar, edits)
        accepted = dict.fromkeys(grammar.accepting, 0)

        def solved() -> Iterator[tuple]:
            for (conv, number), held in _groups(batches, 2):
                read = [r[1:] for r in held]
                if not number and len(held) < BLOCK:
                    labels, cost, found, _ = listed(composition, held, composition.solve(read, [0], accepted, True), 0)
                    yield (conv, number, labels, cost, found, None), len(held)
                    continue
                matrix: list[int | None] = [None] * len(everywhere) ** 2
                for out in everywhere:
                    for s, best in composition.solve(read, everywhere, {out: 0}, False)[0].items():
                        matrix[s * len(everywhere) + out] = best[0]
                yield (conv, number, None, None, None, matrix), len(held)

        yield from one_by_one(solved(), ["conv_id", "block", "labels", "cost", "edits", "matrix"], [key_type, pa.int64(), pa.string(), pa.int64(), pa.list_(_EDIT), pa.list_(pa.int64())])

    spread = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    done = scratch.table(spread.mapInArrow(first, f"conv_id {kind}, block long, labels string, cost long, edits {_EDITS}, matrix array<long>"), "first")
    short = done.where("matrix IS NULL").select("conv_id", "block", "labels", "cost", "edits")
    long = done.where("matrix IS NOT NULL").select("conv_id", "block", "matrix")
    if long.isEmpty():
        return short

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each conversation's last block on, the costs beyond every block."""
        composition = Composition(grammar, edits)
        end = {s: b[0] for s, b in composition.solve([], everywhere, dict.fromkeys(grammar.accepting, 0), True)[0].items()}

        def beyond() -> Iterator[tuple]:
            for (conv,), held in _blocks_of(batches):
                costs, last = [end.get(s) for s in everywhere], True
                for number, matrix in held:
                    yield (conv, number, costs, last), 1
                    rows = [matrix[s * len(everywhere) : (s + 1) * len(everywhere)] for s in everywhere]
                    costs = [min((m + c for m, c in zip(row, costs) if m is not None and c is not None), default=None) for row in rows]
                    last = False

        yield from one_by_one(beyond(), ["conv_id", "block", "exits", "last"], [key_type, pa.int64(), pa.list_(pa.int64()), pa.bool_()])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        composition = Composition(grammar, edits)

        def solved() -> Iterator[tuple]:
            for (conv, number), held in _groups(batches, 2):
                exits, last = held[0][3:]
                accepted = dict.fromkeys(grammar.accepting, 0) if last else {s: c for s, c in enumerate(exits) if c is not None}
                best = composition.solve([r[1:3] for r in held], everywhere, accepted, last)
                for entry in best[0]:
                    labels, cost, found, out = listed(composition, held, best, entry)
                    yield (conv, number, entry, out, labels, cost, found), len(held)

        names = ["conv_id", "block", "entry", "exit", "labels", "cost", "edits"]
        yield from one_by_one(solved(), names, [key_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(_EDIT)])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entry state of every block, from each conversation's first block on."""

        def entries() -> Iterator[tuple]:
            for (conv,), held in _blocks_of(batches):
                state, at, out = 0, None, None
                for number, entry, exit_ in held:
                    if number != at:
                        at, state = number, out if out is not None else 0
                    if entry == state:
                        out = exit_
                        yield (conv, number, entry), 1

        yield from one_by_one(entries(), ["conv_id", "block", "entry"], [key_type, pa.int64(), pa.int64()])

    ordered = long.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    exits = scratch.table(ordered.mapInArrow(weights, f"conv_id {kind}, block long, exits array<long>, last boolean"), "exits")
    e = exits.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "exits", "last")
    same = lambda c, b: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("block") == F.col(b))
    wanted = rows.join(e, same("c", "b")).drop("c", "b").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    ways = scratch.table(wanted.mapInArrow(again, f"conv_id {kind}, block long, entry long, exit long, labels string, cost long, edits {_EDITS}"), "ways")
    paths = ways.select("conv_id", "block", "entry", "exit").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    taken = scratch.table(paths.mapInArrow(followed, f"conv_id {kind}, block long, entry long"), "taken").toDF("c", "b", "entry")
    return short.unionByName(ways.join(taken, same("c", "b") & (ways.entry == taken.entry)).select("conv_id", "block", "labels", "cost", "edits"))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Each conversation's rows as a stream."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for conv, held in groupby(rows, key=lambda r: r[:1]):
        yield conv, (r[1:] for r in held)


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, edit: the repaired conversations; a conversation's rows come in order within one task.

    ``rows`` are those of ``symbols``, ``solved`` those of ``edits_of``; an inserted row has no turn.
    """
    kinds = dict(rows.dtypes)
    own = ("turn", "role", "text")
    told = ("edit", "new_role", "before")
    edits = solved.select("conv_id", F.inline("edits"))
    edits = edits.select("conv_id", "pos", F.lit(0).alias("part"), *(F.lit(None).cast(kinds[c]).alias(c) for c in own), *told)
    texts = rows.select("conv_id", "pos", F.lit(1).alias("part"), *own, *(F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in told))
    both = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit, new = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, _, part, turn, role, text, *said in zip(*(c.to_pylist() for c in batch.columns)):
                if part:
                    if edit != "D":
                        out.append((conv, turn, new or role, text, edit))
                else:
                    edit, new, before = said
                    out += [(conv, None, r, "", "I") for r in before]
            kept = [0, 3, 4, 5]
            types = [*(batch.schema.field(i).type for i in kept), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["conv_id", *own, "edit"])

    return both.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the output of ``repaired``, whose order it follows."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, type_ = None, None, None
        for batch in batches:
            type_, done = batch.column(0).type, []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is not None and conv == at:
                    digest.update(f"\n{role}:{text}".encode())
                else:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type_), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], type_), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def summary(symbols: DataFrame) -> DataFrame:
    """conv_id, gaps and the counts of faults and of illegal neighbours."""
    fault = lambda f: F.count_if(F.col("fault") == f).alias({BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated"}[f])
    pair = F.concat("prior", "initial")
    return symbols.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), fault(BLANK), fault(DUPLICATE), fault(TRUNCATED),
        F.count_if(~pair.isin("su", "ua", "au")).alias("illegal"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage to the rows of ``conversations``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    way = F.crc32(key) % DAMAGE
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), way.alias("way")).where("way <> 0")
    hurt = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), "way")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "structure-repair")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows, signs = symbols(damaged(turns), scratch)
    solved = scratch.table(edits_of(signs, scratch), "solved")
    audit = solved.groupBy("conv_id").agg(
        F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "labels"))), lambda x: x.labels), "").alias("audit"),
    )
    found = turns.select("conv_id").distinct()
    for more in (summary(signs), audit, digests(repaired(rows, solved))):
        found = found.join(more.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _weight(state: str, cost: str, label: str, when: str = "true") -> str:
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} ELSE 1000000000 END, 'l': {state}.l || '{label}'}}"


def _least(*weights: str) -> str:
    return f"list_sort([{', '.join(weights)}])[1]"


_FROM_U = [_weight("iu", "4", "D"), *(_weight(s, "more", "K", "r.keeps AND r.initial = 'u'") for s in ("i0", "iz", "ia")), *(_weight(s, "3 + more", "R", "r.keeps") for s in ("i0", "iz", "ia"))]
_INSERTED = f"w0 AS i0, ws AS iz, {_least('wu', *(_weight(s, '3', 'I') for s in ('w0', 'ws', 'wa')))} AS iu"

ORACLE = f"""
WITH RECURSIVE original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (SELECT *, {CRC_SQL} % 20 AS way FROM original),
hurt AS (
  SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE way <> 0),
placed AS (
  SELECT conv_id, turn, role, text, rtrim(text, {_SPACES}) AS body, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM placed),
signs AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS prior,
    CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM numbered),
rows AS (SELECT *, fault NOT IN ('b', 'd') AS keeps, CASE fault WHEN 't' THEN 3 ELSE 0 END AS more FROM signs),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0, 'l': ''}} AS w0, {{'c': 1000000000, 'l': ''}} AS ws,
    {{'c': 1000000000, 'l': ''}} AS wu, {{'c': 1000000000, 'l': ''}} AS wa FROM rows
  UNION ALL
  SELECT conv_id, pos, {_weight('i0', '4', 'D')}, {_least(_weight('iz', '4', 'D'), _weight('i0', 'more', 'K', "r.keeps AND r.initial = 's'"))},
    {_least(*_FROM_U)},
    {_least(_weight('ia', '4', 'D'), _weight('iu', 'more', 'K', "r.keeps AND r.initial = 'a'"), _weight('iu', '3 + more', 'R', 'r.keeps'))}
  FROM (SELECT conv_id, r.pos, r, r.more AS more, i0, iz, iu, {_least('wa', _weight('iu', '3', 'I'))} AS ia
    FROM (SELECT w.conv_id, r, wa, {_INSERTED} FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1))),
final AS (
  SELECT conv_id, {_least('w0', 'wa', _weight('iu', '3', 'I'))} AS best
  FROM (SELECT conv_id, w0, wa, {_INSERTED} FROM walk w WHERE pos = (SELECT max(pos) FROM rows r WHERE r.conv_id IS NOT DISTINCT FROM w.conv_id))),
steps AS (
  SELECT conv_id, best.l AS audit, i, substr(best.l, i, 1) AS edit, length(replace(substr(best.l, 1, i), 'I', '')) AS pos,
    length(replace(substr(best.l, 1, i), 'D', '')) AS nth
  FROM (SELECT conv_id, best, unnest(range(1, length(best.l) + 1)) AS i FROM final)),
kept AS (
  SELECT s.conv_id, s.i, s.edit, s.nth, r.role, r.text,
    max(CASE WHEN s.nth = 1 AND s.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS shift
  FROM steps s LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos AND s.edit <> 'I' WHERE s.edit <> 'D'),
texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS repaired_sha256 FROM kept GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(f.best.c, 0) AS BIGINT) AS cost, coalesce(f.best.l, '') AS audit,
  coalesce(t.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
