"""The pass before the second walk keeps just the rows with a partner that bounds allow."""

import numpy as np
import pytest

from millrace.llm import prefix_tree_join as P


@pytest.mark.parametrize("most_rows", [3, 10_000])
def test_partnered_rows_by_brute_force(spark, most_rows):
    rng = np.random.default_rng(5)
    rows, sets = [], []
    for cid in range(240):
        base = np.unique(rng.integers(0, 1 << 62, int(rng.choice([4, 30, 500])), dtype=np.uint64)) if cid % 3 == 0 else sets[-1]
        sets.append(base[int(rng.integers(0, 1 + len(base) // 8)) :])
        parity = [int(v) for v in P.sketch(sets[-1])]
        rows.append((int(rng.integers(0, 9)), 0, 0, 0, cid, int(rng.integers(0, 60)), int(rng.integers(0, 3)), 7, len(sets[-1]), P.part_sizes(sets[-1]), *parity))
    names = "t long, g int, side int, chunk int, cid long, comp long, role int, place int, size long, parts binary, s0 long, s1 long, s2 long, s3 long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most_rows)
    try:
        found = P.partnered(spark.createDataFrame(rows, names), ["t", "g", "side", "chunk"], 9, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def allowed(x, y) -> bool:
        if x[0] != y[0] or x[5] == y[5] or {x[6], y[6]} in ({P.MEMBER}, {P.PROBE}) or 9 * x[8] > 10 * y[8] or 9 * y[8] > 10 * x[8]:
            return False
        apart = x[8] + y[8] - 2 * P.needed(x[8], y[8], 9, 10)
        differ = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x[10:], y[10:]))
        spread = sum(abs(p - q) for p, q in zip(x[9], y[9])) if x[9] and y[9] else 0
        return max(differ, spread) <= apart

    want = {x[4] for x in rows if any(x is not y and allowed(x, y) for y in rows)}
    assert 0 < len(want) < len(rows)
    assert sorted(r.cid for r in found) == sorted(want)


def test_partnered_rows_of_nothing(spark):
    names = "t long, g int, side int, chunk int, cid long, comp long, role int, place int, size long, parts binary, s0 long, s1 long, s2 long, s3 long"
    assert P.partnered(spark.createDataFrame([], names), ["t", "g", "side", "chunk"], 9, 10).count() == 0
