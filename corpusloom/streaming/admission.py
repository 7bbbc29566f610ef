"""File slots and the work queue as streams with state: late failures free slots, timers give up on the silent.

A project has a limited number of slots: one for each group, and one for each
source without a group.  Sources ask for one in order.  While all are taken they
wait; a slot whose sources have all failed, or said nothing for too long, goes to
the source that has waited longest.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the driver starts a worker for stateful operators that does not see shipped packages: these classes travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASKS, FAILS, ENDS = "asks", "fails", "ends"
_TURN = "project string, source_id string, slot int, event string"


class Slots(StatefulProcessor):
    """State of one project: for each slot what holds it and how many sources are in it, and for each source its slot or its place in the queue.

    Sources are looked up, never searched for; each event costs two calls to the
    state or three.  The queue is read at most once a batch, when a slot is freed.
    """

    def __init__(self, limit: int, patience_ms: int | None = None):
        self.limit, self.patience = limit, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holders = handle.getMapState("holders", "slot int", "name string, sources long")
        # in a slot, or without one and waiting as the ``nth``
        self.known = handle.getMapState("known", "source_id string", "slot int, nth long, name string, done boolean, until long")
        self.counter = handle.getValueState("counter", "nth long")

    def _begin(self) -> None:
        """What a call keeps at hand: the slots (``limit`` at most), and the queue once it is needed."""
        self.slots = {slot: [name, n] for (slot,), (name, n) in self.holders.iterator()}
        self.slot_of = {name: slot for slot, (name, _) in self.slots.items()}
        self.free = [i for i in range(1, self.limit + 1) if i not in self.slots]  # ascending, so a heap
        self.touched: set[int] = set()
        self.nth = self.counter.get()[0] if self.counter.exists() else 0
        self.first_nth = self.nth
        self.queue: list[int] | None = None
        self.lines: dict[str, dict[int, str]] = {}

    def _end(self) -> None:
        for slot in self.touched:
            if slot in self.slots:
                self.holders.updateValue((slot,), tuple(self.slots[slot]))
            else:
                self.holders.removeKey((slot,))
        if self.nth != self.first_nth:
            self.counter.update((self.nth,))

    def _let_in(self, source: str, name: str, now: int, out: list[tuple]) -> bool:
        """A source enters its group's slot or the least free one, if there is one."""
        slot = self.slot_of.get(name)
        if slot is None:
            if not self.free:
                return False
            slot = self.slot_of[name] = heapq.heappop(self.free)
            self.slots[slot] = [name, 0]
        self.slots[slot][1] += 1
        self.touched.add(slot)
        until = now + self.patience if self.patience else 0
        self.known.updateValue((source,), (slot, None, name, False, until))
        if until:
            self.handle.registerTimer(until)
        out.append((source, slot, "admitted"))
        return True

    def _wait(self, source: str, name: str, out: list[tuple]) -> None:
        self.nth += 1
        self.known.updateValue((source,), (None, self.nth, name, False, 0))
        if self.queue is not None:
            heapq.heappush(self.queue, self.nth)
            self.names[self.nth] = name
            self.lines.setdefault(name, {})[self.nth] = source
        out.append((source, None, "waits"))

    def _leave(self, source: str, now: int, out: list[tuple]) -> None:
        """A source that failed leaves; the last one of a slot frees it for who waits."""
        if not self.known.containsKey((source,)):
            return
        slot, nth, name, _, _ = self.known.getValue((source,))
        self.known.removeKey((source,))
        if slot is None:
            if self.queue is not None:
                self.names.pop(nth)
                self.lines[name].pop(nth)
            return
        out.append((source, slot, "left"))
        self.slots[slot][1] -= 1
        self.touched.add(slot)
        if self.slots[slot][1]:
            return
        del self.slot_of[self.slots.pop(slot)[0]]
        heapq.heappush(self.free, slot)
        self._let_in_next(now, out)

    def _let_in_next(self, now: int, out: list[tuple]) -> None:
        """Free slots go to who has waited longest, and to all who wait in the same group; nobody waits whose group has a slot."""
        if self.queue is None:
            waiters = sorted((nth, source, name) for (source,), (slot, nth, name, _, _) in self.known.iterator() if slot is None)
            self.queue, self.names = [nth for nth, _, _ in waiters], {nth: name for nth, _, name in waiters}
            for nth, source, name in waiters:
                self.lines.setdefault(name, {})[nth] = source
        while self.free and self.queue:
            name = self.names.get(heapq.heappop(self.queue))  # none: that one has left the queue
            if name is not None:
                for nth, waiter in list(self.lines.pop(name).items()):
                    self.names.pop(nth)
                    self._let_in(waiter, name, now, out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = timerValues.getCurrentProcessingTimeInMs() if self.patience else 0
        events = sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r.no)
        self._begin()
        for r in events:
            if r.event == ASKS:
                if self.known.containsKey((r.source_id,)):
                    continue
                name = f"g:{r.group.strip()}" if isinstance(r.group, str) and r.group.strip() else f"s:{r.source_id}"
                if not self._let_in(r.source_id, name, now, out):
                    self._wait(r.source_id, name, out)
            elif r.event == FAILS:
                self._leave(r.source_id, now, out)
            elif r.event == ENDS and self.known.containsKey((r.source_id,)):
                slot, _, name, _, _ = self.known.getValue((r.source_id,))
                if slot is not None:
                    self.known.updateValue((r.source_id,), (slot, None, name, True, 0))
                    out.append((r.source_id, slot, "done"))
        self._end()
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        self._begin()
        for (source,), (slot, _, _, done, until) in list(self.known.iterator()):
            if slot is not None and not done and until and until <= now:
                self._leave(source, now, out)
        self._end()
        yield self._frame(key, out)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["source_id", "slot", "event"])
        frame.insert(0, "project", key[0])
        return frame.astype({"slot": "Int32"})

    def close(self) -> None:
        pass


def stream_slots(events: DataFrame, limit: int, patience_ms: int | None = None) -> DataFrame:
    """``project, source_id, slot, event`` (admitted, waits, left, done) from events ``project, no, source_id, group, event``.

    ``event`` is asks, fails or ends; ``no`` orders a project's events.  Null or
    blank groups are none.  With ``patience_ms`` a source that neither fails nor
    ends within that time leaves; timers also run while no events come, so such a
    query is never done by itself (``noDataMicroBatches`` off ends it with its data).  State is one row for each source that is
    inside or waits, so a project is bounded by its queue.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.coalesce("project", F.lit("")).alias("project"), "no", "source_id", "group", "event")
    return rows.groupBy("project").transformWithStateInPandas(statefulProcessor=Slots(limit, patience_ms), outputStructType=_TURN, outputMode="Append", timeMode="ProcessingTime" if patience_ms else "None")


class Queue(StatefulProcessor):
    """Projects in the order of their first request; each is drained before the next begins."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "project string", "first long, items array<string>")
        self.running = handle.getValueState("running", "project string, left long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for r in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r.no):
            if r.event == ASKS:
                first, items = self.pending.getValue((r.project,)) if self.pending.containsKey((r.project,)) else (int(r.no), [])
                self.pending.updateValue((r.project,), (first, [*items, r.item]))
            elif self.running.exists() and self.running.get()[0] == r.project:
                left = self.running.get()[1] - 1
                self.running.update((r.project, left)) if left else self.running.clear()
            if not self.running.exists():
                self._next(out)
        frame = pd.DataFrame(out, columns=["project", "item", "nth"])
        frame.insert(0, "queue", key[0])
        yield frame.astype({"nth": "int32"})

    def _next(self, out: list[tuple]) -> None:
        """All pending items of the project that was first asked for begin."""
        waiting = sorted((first, project) for (project,), (first, _) in self.pending.iterator())
        if waiting:
            project = waiting[0][1]
            items = self.pending.getValue((project,))[1]
            self.pending.removeKey((project,))
            self.running.update((project, len(items)))
            out.extend((project, item, i) for i, item in enumerate(items, 1))

    def close(self) -> None:
        pass


def stream_queue(events: DataFrame) -> DataFrame:
    """``queue, project, item, nth``: what begins, from events ``queue, no, project, item, event`` (asks, ends).

    One project of a queue runs at a time.  What is asked for while it runs waits
    for its turn, even if it belongs to the same project; the next project
    begins when each item of the running one has ended.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.select("queue", "no", "project", "item", "event").groupBy("queue").transformWithStateInPandas(
        statefulProcessor=Queue(), outputStructType="queue string, project string, item string, nth int", outputMode="Append", timeMode="None"
    )
