"""Event queues on Structured Streaming: keyed dedup, late-data drop, retry states."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OVERLAP = "15 minutes"
MAX_ATTEMPTS, MAX_AGE_DAYS = 12, 7


def on_time(rows: DataFrame, ts: str, now: Column, days: int = MAX_AGE_DAYS) -> DataFrame:
    """Rows from the last ``days`` days; future and undated rows go too."""
    c = F.col(ts)
    return rows.where((c <= now) & (c >= now - F.expr(f"interval {days} days")))


def first_events(events: DataFrame, key: str, ts: str, within: str | None = OVERLAP) -> DataFrame:
    """Each key once per overlap window of a stream (or once ever without a window, at the price of state)."""
    if within is None:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def next_state(outcome: Column, attempts: Column, age_days: Column) -> Column:
    """State after an attempt: resolved, closed, abandoned or retry."""
    worn = (attempts >= MAX_ATTEMPTS) | (age_days > MAX_AGE_DAYS)
    return F.when(outcome == "resolved", "resolved").when(outcome == "closed", "closed").when(worn, "abandoned").otherwise("retry")


def retry_states(events: DataFrame, key: str, outcome: str, order: str) -> DataFrame:
    """Per key its state and attempts so far, over a stream of attempt outcomes.

    State is two small values a key.  Terminal states stay.  Rows of a key in one
    micro-batch are taken by ``order``; updates come out once per key and batch.
    """

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts = state.get if state.exists else ("pending", 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for got in rows[outcome]:
            if now in ("resolved", "closed", "abandoned"):
                break
            attempts += 1
            now = got if got in ("resolved", "closed") else "abandoned" if attempts >= MAX_ATTEMPTS else "retry"
        state.update((now, attempts))
        yield pd.DataFrame({"key": [k[0]], "state": [now], "attempts": [attempts]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, state string, attempts long", "state string, attempts long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into Parquet (append) or batch by batch (update)."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start()
    query.awaitTermination()
