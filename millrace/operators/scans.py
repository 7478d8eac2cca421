"""Ordered scans of keyed rows that stay distributed where one key has any share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_scan(
    rows: DataFrame,
    key: str,
    order: list[Column | str],
    values: list[str],
    state: str,
    lift: Callable[..., tuple],
    join: Callable[[tuple, tuple], tuple],
    keep: list[str],
    cut: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``keep`` columns of each row and the fold of its key's rows up to it, in ``order``.

    ``lift(*values)`` makes a row's state, ``join`` is an associative function of two
    states, and ``state`` is the DDL of their fields.  Rows are sorted by ranges of
    (key, order), so a key may span many tasks: each task folds its own rows, ``cut``
    writes them, and the states at the tasks' ends (one row a task, the only thing that
    reaches the driver) are folded and joined to the rows of the key that goes on.  Rows
    that tie in ``order`` come in any order, so it should tell apart what differs.  A
    null key is a key like any other; an empty table gives no rows.
    """
    fields = [f.split()[0] for f in state.split(", ")]
    kinds = dict(rows.dtypes)
    taken = [*keep, *fields]
    part, place, at_key = (_spare(n, taken) for n in ("scan_part", "scan_place", "scan_key"))
    sent = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    sent = sent.select(F.spark_partition_id().alias(part), F.col(key).alias(at_key), *(F.col(v).alias(_spare(f"scan_{i}", taken)) for i, v in enumerate(values)), *keep)
    width = len(values)
    schema = ", ".join([f"`{part}` int", f"`{place}` long", *(f"`{c}` {kinds[c]}" for c in keep), state])
    arrow = _arrow_types(rows, state)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, n = None, None, 0
        for batch in batches:
            out = []
            lifted = zip(*(batch.column(2 + i).to_pylist() for i in range(width))) if width else ((),) * batch.num_rows
            for k, v in zip(batch.column(1).to_pylist(), lifted):
                known = join(known, lift(*v)) if known is not None and k == at else lift(*v)
                at = k
                out.append(known)
            states = [pa.array([s[i] for s in out], t) for i, t in enumerate(arrow)]
            places = pa.array(range(n, n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), places, *batch.columns[2 + width :], *states], [part, place, *taken])

    if key not in keep:
        raise ValueError("the key must be kept")
    done = cut(sent.mapInArrow(local, schema))
    ends = F.struct(F.col(key).alias("k"), F.struct(*fields).alias("s"))
    bounds = done.groupBy(part).agg(F.min_by(F.struct(F.col(key).alias("k")), place).alias("first"), F.max_by(ends, place).alias("last")).collect()
    before: dict[int, tuple] = {}
    at, carried = None, None
    for b in sorted(bounds, key=lambda b: b[part]):
        goes_on = carried is not None and b["first"]["k"] == at
        if goes_on:
            before[b[part]] = (at, carried)
        last = tuple(b["last"]["s"])
        carried = join(carried, last) if goes_on and b["last"]["k"] == at else last
        at = b["last"]["k"]
    if not before:
        return done.select(*taken)
    key_at = 2 + keep.index(key)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 2 + len(keep)
            parts = batch.column(0).to_pylist()
            if before.keys().isdisjoint(parts):
                yield pa.RecordBatch.from_arrays(batch.columns[2:], taken)
                continue
            out = []
            for p, k, s in zip(parts, batch.column(key_at).to_pylist(), zip(*(c.to_pylist() for c in batch.columns[first:]))):
                b = before.get(p)
                out.append(join(b[1], s) if b is not None and b[0] == k else s)
            states = [pa.array([s[i] for s in out], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:first], *states], taken)

    return done.mapInArrow(resolve, schema.split(", ", 2)[2])


def _spare(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _arrow_types(rows: DataFrame, state: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in rows.sparkSession.createDataFrame([], state).schema]


def count_state(*_) -> tuple[int]:
    """A row's own count, for running counts with ``add_states``."""
    return (1,)


def add_states(x: tuple, y: tuple) -> tuple:
    return tuple(a + b for a, b in zip(x, y))


def until_enough(rows: DataFrame, order: list[Column | str], counts: Column, most: int, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows that a scan in ``order`` takes that passes over some and stops at the ``most``-th that counts.

    The second table is one row: considered (all rows), taken (rows that count, ``most``
    at the highest) and passed (rows that don't, up to the stop).  A null condition
    doesn't count.  Running counts are prefix sums over ranges, so no task sees all rows;
    ``order`` should be total.
    """
    flag, all_ = _spare("counts_", rows.columns), _spare("all_", rows.columns)
    marked = rows.withColumns({flag: F.coalesce(counts, F.lit(False)).cast("int"), all_: F.lit(0)})
    scanned = ordered_scan(marked, all_, order, [flag], "scan_count long", lambda n: (n,), add_states, [*rows.columns, all_, flag], cut)
    taken = scanned.where((F.col(flag) == 1) & (F.col("scan_count") <= most)).select(*rows.columns)
    passed = (F.col(flag) == 0) & (F.col("scan_count") < most)
    return taken, scanned.agg(F.count("*").alias("considered"), F.count_if((F.col(flag) == 1) & (F.col("scan_count") <= most)).alias("taken"), F.count_if(passed).alias("passed"))
