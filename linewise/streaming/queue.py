"""A queue of works as a stateful stream: what was asked for is done one after the other, and what is asked for again is not done twice.

State is kept by queue: what runs, and what waits in order. Another queue is another key, so queues spread over tasks; a stream that ends anywhere goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "queue string, at timestamp, event string, work string, instruction string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Queue:
    """What runs and what waits; each step gives (event, work, instruction)."""

    def __init__(self, running: tuple[str, str] | None = None, waiting: Iterable[tuple[str, str]] = ()):
        self.running = running
        self.waiting = dict(waiting)  # in the order of the first request

    def asked(self, work: str, instruction: str) -> Iterator[tuple[str, str, str]]:
        """One more request: begins at once if nothing runs; of a work that waits the later instruction counts, if there is one."""
        if self.running is None:
            self.running = work, instruction
            yield "started", work, instruction
        elif work in self.waiting:
            if instruction:
                self.waiting[work] = instruction
            yield "updated" if instruction else "repeated", work, self.waiting[work]
        elif self.running[0] == work:
            yield "repeated", work, self.running[1]
        else:
            self.waiting[work] = instruction
            yield "queued", work, instruction

    def ended(self, work: str, how: str) -> Iterator[tuple[str, str, str]]:
        """What runs is over; the next that waits begins. Other works than the running one are not heard."""
        if self.running is None or self.running[0] != work:
            return
        yield how, *self.running
        self.running = None
        for nxt in list(self.waiting)[:1]:
            yield from self.asked(nxt, self.waiting.pop(nxt))

    def dropped(self, work: str) -> Iterator[tuple[str, str, str]]:
        if work in self.waiting:
            yield "removed", work, self.waiting.pop(work)

    def step(self, kind: str, work: str, instruction: str) -> Iterator[tuple[str, str, str]]:
        if kind == "ask":
            yield from self.asked(work, instruction)
        elif kind in ("done", "error", "stopped"):
            yield from self.ended(work, kind)
        elif kind == "remove":
            yield from self.dropped(work)


class QueueProcessor(StatefulProcessor):
    """Keeps a Queue in the state of its key. What runs longer than `limit` seconds of event time has ended with `timeout`."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "work string, instruction string")
        self.waiting = handle.getListState("waiting", "work string, instruction string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        queue, out = self._queue(), []
        for row in batch.itertuples():
            before = queue.running
            out += [(row.at, *e) for e in queue.step(row.kind, row.work, (row.instruction or "").strip())]
            self._watch(before, queue.running, row.at)
        self._keep(queue)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queue = self._queue()
        at = pd.Timestamp(datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc)).tz_localize(None)
        before = queue.running
        out = [(at, *e) for e in queue.ended(before[0], "timeout")] if before else []
        self._watch(before, queue.running, at)
        self._keep(queue)
        yield self._rows(key, out)

    def _watch(self, before, now, at: pd.Timestamp) -> None:
        """One timer at a time: that of what runs now."""
        if now is not before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if now:
                self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + 1000 * self.limit)

    def _queue(self) -> Queue:
        return Queue(tuple(self.running.get()) if self.running.exists() else None, (tuple(x) for x in self.waiting.get()) if self.waiting.exists() else ())

    def _keep(self, queue: Queue) -> None:
        self.running.update(queue.running) if queue.running else self.running.clear()
        self.waiting.put(list(queue.waiting.items())) if queue.waiting else self.waiting.clear()

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=["queue", "at", "event", "work", "instruction"])

    def close(self) -> None:
        pass


def queue_events(requests: DataFrame, late: str = "10 minutes", limit: int = 6 * 3600) -> DataFrame:
    """(queue, at, event, work, instruction) of a stream (queue, at, seq, kind, work, instruction).

    kind is ask, remove, or done, error or stopped of what runs. Rows of one queue count in order of time and seq within what arrives together; rows later than `late` are
    left out. Events are started, queued, updated, repeated, removed, the kinds of end, and timeout. Needs the state store of `PROVIDER` in spark.sql.streaming.stateStore.providerClass.
    """
    rows = requests.withWatermark("at", late)
    return rows.groupBy("queue").transformWithStateInPandas(QueueProcessor(limit), EVENTS, "append", "EventTime")
