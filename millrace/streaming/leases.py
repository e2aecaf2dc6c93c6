"""Leases over streams: uptimes of machines that end by timer, and task leases that turn into zombies, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "servant long, discovered_at timestamp, expires_at timestamp, beats long"
TASK_SCHEMA = "servant long, grant_id long, ts timestamp, event_id long, outcome string"
_UPTIME = ["servant", "discovered_at", "expires_at", "beats"]


def _millis(at: pd.Timestamp) -> int:
    """The first whole millisecond after ``at``: a lease that ends at that very moment still holds."""
    return at.value // 1_000_000 + 1


class LeaseProcessor(StatefulProcessor):
    """Keeps first and last heartbeat of each machine's uptime, which ends by the first heartbeat after its lease or by a timer.

    Rows of a key are ordered by (ts, event_id) inside a batch. A heartbeat older than the last one only counts and does not
    move the lease; one older than the watermark is dropped.
    """

    def __init__(self, lease_seconds: int):
        self.lease = pd.Timedelta(seconds=lease_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("uptime", "first timestamp, last timestamp, beats long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(rows).sort_values(["ts", "event_id"])
        first, last, beats = self.state.get() if self.state.exists() else (None, None, 0)
        if last is not None:
            self.handle.deleteTimer(_millis(pd.Timestamp(last) + self.lease))
        out = []
        for ts in got["ts"]:
            if last is not None and ts > pd.Timestamp(last) + self.lease:
                out.append((key[0], first, pd.Timestamp(last) + self.lease, beats))
                first, last, beats = None, None, 0
            first = ts if first is None else first
            last = ts if last is None else max(pd.Timestamp(last), ts)
            beats += 1
        self.state.update((pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), beats))
        self.handle.registerTimer(_millis(pd.Timestamp(last) + self.lease))
        yield pd.DataFrame(out, columns=_UPTIME)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, beats = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], first, pd.Timestamp(last) + self.lease, beats)], columns=_UPTIME)

    def close(self) -> None:
        pass


def lease_stream(beats: DataFrame, lease_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Ended uptimes of a streaming DataFrame (servant, ts timestamp, event_id): a silent machine's ends once the watermark,
    which trails the newest heartbeat by ``late``, has passed its lease."""
    beats = beats.withWatermark("ts", late)
    return beats.groupBy("servant").transformWithStateInPandas(LeaseProcessor(lease_seconds), SCHEMA, "Append", "EventTime")


class TaskLeaseProcessor(StatefulProcessor):
    """Task leases of one machine, as a map of its grants to (lease end, zombie).

    ``grant`` opens a lease of ``lease_ms``; ``renew`` extends it, but is refused for unknown grants and zombies; ``free``
    ends it. A lease that ends before a row's time makes its grant a zombie, which keeps its slot until a ``report`` of the
    machine no longer lists it; grants that a report lists without a live lease are answered as ``unknown``, to be killed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leases = handle.getMapState("leases", "grant_id long", "ends timestamp, zombie boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: [pd.Timestamp(v[0]), v[1]] for k, v in self.leases.iterator()}
        known, out = set(held), []
        for r in pd.concat(rows).sort_values(["ts", "event_id"]).itertuples():
            for lease in held.values():
                lease[1] = lease[1] or lease[0] < r.ts
            say = lambda g, what: out.append((key[0], g, r.ts, r.event_id, what))  # noqa: B023, E731
            if r.action == "report":
                listed = set() if r.running is None else set(r.running)
                for g in sorted(listed):
                    if g not in held or held[g][1]:
                        say(g, "unknown")
                for g in sorted(g for g, lease in held.items() if lease[1] and g not in listed):
                    del held[g]
                    say(g, "swept")
            elif r.action == "grant":
                held[r.grant_id] = [r.ts + pd.Timedelta(milliseconds=int(r.lease_ms)), False]
                say(r.grant_id, "granted")
            elif r.action == "renew":
                live = r.grant_id in held and not held[r.grant_id][1]
                if live:
                    held[r.grant_id][0] = r.ts + pd.Timedelta(milliseconds=int(r.lease_ms))
                say(r.grant_id, "renewed" if live else "refused")
            elif r.action == "free" and held.pop(r.grant_id, None):
                say(r.grant_id, "freed")
        for g in known - set(held):
            self.leases.removeKey((g,))
        for g, (ends, zombie) in held.items():
            self.leases.updateValue((g,), (ends.to_pydatetime(), zombie))
        yield pd.DataFrame(out, columns=["servant", "grant_id", "ts", "event_id", "outcome"])

    def close(self) -> None:
        pass


def task_lease_stream(actions: DataFrame) -> DataFrame:
    """What becomes of each of the ``actions`` (servant, ts, event_id, action, grant_id, lease_ms, running array<long>) on
    task leases. A machine's state is its open grants, so it is bounded by what the machine may run."""
    return actions.groupBy("servant").transformWithStateInPandas(TaskLeaseProcessor(), TASK_SCHEMA, "Append", "None")


def windowed_counts(beats: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Heartbeats per window and kind with a watermark: late rows within ``late`` still count."""
    return beats.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
