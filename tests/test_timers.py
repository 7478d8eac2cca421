"""Queues with clocks: rules by hand, timers that fire, finished items that leave the store, several batches."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.streaming import timers

M, D = timers.MINUTE, timers.DAY
SCHEMA = "key string, event string, at long, seq long"


def test_retry_rules():
    rules = timers.Retries()
    item, at = None, 0
    waits = []
    for _ in range(5):
        item = timers.taken(rules, item, "failed", at)
        waits.append((item.next_at - at) // M)
        at = item.next_at
    assert waits == [20, 40, 80, 120, 120]
    assert timers.taken(rules, item, "resolved", at).state == "resolved"
    for _ in range(7):
        item = timers.taken(rules, item, "failed", at)
    assert (item.state, item.attempts) == ("abandoned", 12)
    assert timers.taken(rules, item, "resolved", at + 1)[:2] == ("abandoned", 12)
    assert timers.taken(rules, item, "failed", at + 7 * D)[:2] == ("retry", 1)
    old = timers.taken(rules, timers.taken(rules, None, "failed", 0), "failed", 7 * D + 1)
    assert (old.state, old.attempts) == ("abandoned", 2)


def test_score_rules():
    rules = timers.Scores()
    run = lambda *events: [timers.Item(*i)[:3] for i in _states(rules, events)]
    assert run(("claim", 0), ("fail", 10), ("claim", 20), ("claim", 10 + M), ("fail", 11 + M)) == [
        ("running", 1, 0), ("retryable", 1, 10 + M), ("retryable", 1, 10 + M), ("running", 2, 10 + M), ("retryable", 2, 11 + 6 * M),
    ]
    assert run(("claim", 0), ("claim", 3 * M))[-1] == ("running", 2, 3 * M)  # the first run's lease was over
    assert run(("claim", 0), ("error", 1), ("claim", 2))[-1] == ("permanent", 1, 1)
    assert run(("claim", 0), ("claim", 2 * M), ("claim", 4 * M), ("queue", 6 * M))[-1] == ("permanent", 3, 6 * M)
    assert run(("queue", 5), ("succeed", 6)) == [("pending", 0, 5), ("pending", 0, 5)]


def _states(rules, events):
    item = None
    for event, at in events:
        item = timers.taken(rules, item, event, at)
        yield item


@pytest.fixture
def drained(spark, tmp_path):
    """The updates of a queue over batches of (key, event, at, seq)."""

    def run(rules, batches):
        at = f"{tmp_path}/{uuid.uuid4().hex}"
        for i, rows in enumerate(batches):
            frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at"))
            frame.coalesce(1).write.parquet(f"{at}/in/slice={i:03d}")
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/slice=*")
        timers.run_queue(timers.queue_states(stream, rules), f"{at}/out", f"{at}/checkpoint")
        return spark.read.parquet(f"{at}/out"), f"{at}/checkpoint"

    return run


def test_timers_fire_and_finished_items_leave(spark, drained):
    start = 1_700_000_000 * timers.SECOND
    rules = timers.Scores(keep=D)
    updates, checkpoint = drained(rules, [
        [("a", "claim", start, 1), ("b", "claim", start, 2), ("c", "claim", start, 3), ("c", "succeed", start + 1, 4)],
        [("b", "fail", start + M, 5), ("x", "queue", start + 30 * M, 6)],
        [("x", "queue", start + 40 * M, 7)],
        [("x", "claim", start + 3 * D, 8)], [("x", "succeed", start + 3 * D + 1, 9)], [("y", "queue", start + 5 * D, 10)], [("y", "queue", start + 5 * D + M, 11)],
    ])
    found = {(r.key, r.cause, r.state, (r.at - start) // M) for r in updates.where("cause <> 'event'").collect()}
    assert ("a", "lapsed", "retryable", 2) in found
    assert ("a", "due", "retryable", 2) in found
    assert ("b", "due", "retryable", 2) in found
    assert ("c", "expired", "succeeded", 1440) in found
    assert ("x", "expired", "succeeded", 4 * 1440) in found
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "item").load()
    assert {r[0].key for r in held.select("key").collect()} == {"a", "b", "y"}


def test_batches_do_not_change_the_end(drained):
    r = random.Random(7)
    start = int(datetime.datetime(2024, 1, 1).timestamp()) * timers.SECOND
    at, rows = start, []
    for seq in range(300):
        at += r.choice([0, 20, 90, 200]) * timers.SECOND
        rows.append((r.choice("abcd"), r.choice(["claim", "claim", "fail", "succeed", "error", "queue"]), at, seq))
    rules = timers.Scores(keep=30 * M)
    want = {}
    for key, event, when, _ in rows:
        want[key] = timers.taken(rules, want.get(key), event, when)
    for size in (300, 75):
        updates, _ = drained(rules, [rows[i : i + size] for i in range(0, 300, size)])
        last = updates.where("cause = 'event'").groupBy("key").agg(F.max_by(F.struct("state", "attempts", "next_at", "steps"), F.struct("at", "steps")).alias("s")).collect()
        assert {x.key: tuple(x.s) for x in last} == {k: (*i[:3], i.steps) for k, i in want.items()}
