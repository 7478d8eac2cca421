"""Work queues with clocks on Structured Streaming: retries, leases and expiry by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER, _IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


class Item(NamedTuple):
    """What a queue keeps of a key; times are in microseconds, ``steps`` counts the events that it took."""

    state: str
    attempts: int
    next_at: int
    since: int
    first_at: int
    steps: int


@dataclass(frozen=True)
class Retries:
    """Attempts with outcomes resolved, closed or anything else: a failed one is tried again, later each time.

    After ``most`` attempts or ``oldest`` after the first event a failure abandons the
    item.  An item that is done is kept for ``keep``; an event after that starts anew.
    """

    most: int = 12
    oldest: int = 7 * DAY
    base: int = 10 * MINUTE
    top: int = 120 * MINUTE
    doublings: int = 4
    keep: int = 7 * DAY
    done: tuple[str, ...] = ("resolved", "closed", "abandoned")

    def start(self, at: int) -> Item:
        return Item("pending", 0, at, at, at, 0)

    def step(self, item: Item, event: str, at: int) -> Item:
        item = item._replace(steps=item.steps + 1)
        if item.state in self.done:
            return item
        attempts = item.attempts + 1
        if event in ("resolved", "closed"):
            return item._replace(state=event, attempts=attempts, next_at=at, since=at)
        if attempts >= self.most or at - item.first_at > self.oldest:
            return item._replace(state="abandoned", attempts=attempts, next_at=at, since=at)
        wait = min(self.top, self.base * 2 ** min(attempts, self.doublings))
        return item._replace(state="retry", attempts=attempts, next_at=at + wait, since=at)

    def deadline(self, item: Item) -> tuple[str, int] | None:
        """What happens to an item by itself, and when."""
        if item.state in self.done:
            return "expired", item.since + self.keep
        return ("due", item.next_at) if item.state == "retry" else None

    def lapse(self, item: Item, at: int) -> Item:
        return item


@dataclass(frozen=True)
class Scores:
    """Claimed work: pending -> running -> succeeded, retryable (after a pause) or permanent.

    A claim counts from the next attempt's time on.  A failed attempt is retried after
    its pause until ``most`` attempts are made; a permanent error isn't.  A run that
    isn't heard of for ``lease`` ends as a failure.  Queueing an item that is done
    does nothing until it has been kept for ``keep``.
    """

    most: int = 3
    pauses: tuple[int, ...] = (MINUTE, 5 * MINUTE)
    lease: int = 2 * MINUTE
    keep: int = 7 * DAY
    done: tuple[str, ...] = ("succeeded", "permanent")

    def start(self, at: int) -> Item:
        return Item("pending", 0, at, at, at, 0)

    def step(self, item: Item, event: str, at: int) -> Item:
        item = item._replace(steps=item.steps + 1)
        if event == "claim" and item.state in ("pending", "retryable") and item.next_at <= at:
            return item._replace(state="running", attempts=item.attempts + 1, next_at=at, since=at)
        if item.state != "running":
            return item
        if event == "succeed":
            return item._replace(state="succeeded", next_at=at, since=at)
        if event == "fail" and item.attempts < self.most:
            return item._replace(state="retryable", next_at=at + self.pauses[item.attempts - 1], since=at)
        return item._replace(state="permanent", next_at=at, since=at) if event in ("fail", "error") else item

    def deadline(self, item: Item) -> tuple[str, int] | None:
        if item.state in self.done:
            return "expired", item.since + self.keep
        if item.state == "running":
            return "lapsed", item.since + self.lease
        return ("due", item.next_at) if item.state == "retryable" else None

    def lapse(self, item: Item, at: int) -> Item:
        """A run whose lease is over: tried again at once, unless that was the last attempt."""
        return item._replace(state="permanent" if item.attempts >= self.most else "retryable", next_at=at, since=at)


Rules = Retries | Scores


def settle(rules: Rules, item: Item | None, at: int) -> Item | None:
    """The item as it is at a time without further events; None once it has expired."""
    while item is not None:
        what = rules.deadline(item)
        if what is None or what[0] == "due" or what[1] > at:
            return item
        item = None if what[0] == "expired" else rules.lapse(item, what[1])
    return None


def taken(rules: Rules, item: Item | None, event: str, at: int) -> Item:
    """The item after an event; what its clocks did before that comes first."""
    now = settle(rules, item, at)
    return rules.step(rules.start(at) if now is None else now, event, at)


class Queue(StatefulProcessor):
    """One item a key under ``rules``.

    Rows come out for every event (cause ``event``), or for the last one of a key and
    batch if not ``every``, and for every timer: ``due`` when a next attempt's time has
    come, ``lapsed`` when a lease is over, ``expired`` when a finished item leaves the
    store.  Timers fire with the watermark; an event that comes first sees the same item,
    as clocks are settled before it is taken.  The state has the time of the item's timer,
    so that no timer is looked for.
    """

    def __init__(self, rules: Rules, every: bool = True):
        self.rules, self.every = rules, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "state string, attempts long, next_at long, since long, first_at long, steps long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.item.get()
        item, timer = (None, None) if kept is None else (Item(*kept[:-1]), kept[-1])
        at = 0
        for at, _, event in sorted((r["at"], r["seq"], r["event"]) for r in rows):
            item = taken(self.rules, item, event, at)
            if self.every:
                yield self._row(key, item, at, "event")
        if not self.every:
            yield self._row(key, item, at, "event")
        self._keep(item, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.item.get()
        if kept is None:
            return
        item, now = Item(*kept[:-1]), expiredTimerInfo.getExpiryTimeInMs() * 1000
        while (what := self.rules.deadline(item)) is not None and what[1] <= now:
            cause, at = what
            if cause == "lapsed":
                item = self.rules.lapse(item, at)
            yield self._row(key, item, at, cause)
            if cause == "expired":
                self.item.clear()
                return
            if cause == "due":  # nothing more happens to it before its next event
                self.item.update((*item, None))
                return
        self._keep(item, None)

    def close(self) -> None:
        pass

    def _keep(self, item: Item, timer: int | None) -> None:
        what = self.rules.deadline(item)
        wanted = None if what is None else -(-what[1] // 1000)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.item.update((*item, wanted))

    @staticmethod
    def _row(key: tuple, item: Item, at: int, cause: str) -> Row:
        return Row(key=key[0], state=item.state, attempts=item.attempts, next_at=item.next_at, at=at, cause=cause, steps=item.steps)


def queue_states(events: DataFrame, rules: Rules, late: str = "10 minutes", every: bool = True) -> DataFrame:
    """The updates of every key's item over a stream of events.

    ``events``: key, event, at (microseconds), ts (the same as a timestamp) and seq, which
    decides between events of one time.  Events that come later than ``late`` behind the
    newest one are dropped by the watermark.  A key holds one small item; nothing of it
    stays once it has expired.  Without ``every`` a key's events of a batch give one row.
    """
    kind = events.schema["key"].dataType.simpleString()
    out = f"key {kind}, state string, attempts long, next_at long, at long, cause string, steps long"
    return events.withWatermark("ts", late).groupBy("key").transformWithState(statefulProcessor=Queue(rules, every), outputStructType=out, outputMode="Update", timeMode="EventTime")


def run_queue(stream: DataFrame, path: str, checkpoint: str, idle: bool = True) -> None:
    """Runs a queue over what is there now, one table of updates a batch, with its state in RocksDB.

    Without ``idle`` no batch of timers follows the last rows; they fire in the next run.
    """
    conf = stream.sparkSession.conf
    wanted = {_PROVIDER: ROCKSDB, _IDLE: str(idle).lower()}
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("update")
        writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start().awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
