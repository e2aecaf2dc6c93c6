"""Uptimes and task leases as two chained keyed operators: a machine that ends takes its grants with it.

The first operator turns heartbeats into changes of a machine, up and down; the second holds the grants of each machine and
reads these changes among the actions on them.  Both keep rows until the watermark has passed them and take them in order of
time, so results do not depend on how rows fall into batches.  Ends of leases come by timer, without a further row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that one value of the state holds at most.
_PACKED = 10_000
#: Event id of the end of a silent machine: after all rows of that moment.
SILENT = 1 << 62
_ORDER = {"up": 0, "down": 2}
_CHANGES = "servant long, seen_at timestamp, at long, event_id long, change string"
_ENDS = "servant long, grant_id long, granted_at long, at long, outcome string, renewals long"


class InOrder(StatefulProcessor):
    """Takes the rows of a key in order of (at, event_id) once the watermark is ``slack`` milliseconds past them.

    A later operator of a chain needs more slack than an earlier one, so that it has all of its rows of that time. Times are
    microseconds, rows are held many to a value of the state. Rows older than the watermark have been dropped before; those of one time and id go by ``rank``."""

    columns: list[str]
    out: list[str]

    def __init__(self, slack: int):
        self.slack = slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")

    def rank(self, row: tuple) -> tuple:
        return row[0], row[1]

    @staticmethod
    def _packed(rows: list[tuple]) -> list[tuple]:
        return [(pickle.dumps(rows[i : i + _PACKED]),) for i in range(0, len(rows), _PACKED)]

    def _wake(self, at: int | None) -> None:
        if at is not None:
            self.handle.registerTimer(at // 1000 + self.slack + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            got = [self.parsed(r) for r in pdf[self.columns].itertuples(index=False, name=None)]
            if got:
                self.pending.appendList(self._packed(got))
                first = min([r[0] for r in got] + ([] if first is None else [first]))
        self._wake(first)
        yield pd.DataFrame([], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        horizon = (now - self.slack) * 1000
        held = [r for packed in self.pending.get() for r in pickle.loads(packed[0])] if self.pending.exists() else []
        due, later = sorted((r for r in held if r[0] <= horizon), key=self.rank), [r for r in held if r[0] > horizon]
        if due:
            self.pending.put(self._packed(later)) if later else self.pending.clear()
        made, wake = self.advance(key[0], due, horizon)
        self._wake(min([r[0] for r in later] + ([] if wake is None else [wake]), default=None))
        yield self.framed(made, now)

    def parsed(self, row: tuple) -> tuple:
        return row

    def framed(self, made: list[tuple], now: int) -> pd.DataFrame:
        return pd.DataFrame(made, columns=self.out)

    def advance(self, key, due: list[tuple], horizon: int) -> tuple[list[tuple], int | None]:
        """Rows that follow from ``due`` and from the time up to ``horizon``, and when to look again."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Uptimes(InOrder):
    """Changes of a machine from its heartbeats (at, event_id, lease_ms): up with the first, down once no lease is left, or at
    once with a lease of 0. A lease that ends at that very moment still holds."""

    columns, out = ["at", "event_id", "lease_ms"], ["servant", "seen_at", "at", "event_id", "change"]

    def __init__(self, slack: int, zone: str):
        super().__init__(slack)
        self.zone = zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", "until long")

    def parsed(self, row):
        return int(row[0]), int(row[1]), 0 if pd.isna(row[2]) else int(row[2])

    def advance(self, key, due, horizon):
        until, made = self.until.get()[0] if self.until.exists() else None, []
        for at, event, lease in due:
            if until is not None and at > until:
                made.append((key, until, SILENT, "down"))
                until = None
            if lease > 0:
                if until is None:
                    made.append((key, at, event, "up"))
                until = at + lease * 1000
            elif until is not None:
                made.append((key, at, event, "down"))
                until = None
        if until is not None and until <= horizon:
            made.append((key, until, SILENT, "down"))
            until = None
        self.until.clear() if until is None else self.until.update((until,))
        return made, until

    def framed(self, made, now):
        seen = pd.Timestamp(now, unit="ms", tz="UTC").tz_convert(self.zone).tz_localize(None)
        return pd.DataFrame([(k, seen, *rest) for k, *rest in made], columns=self.out).astype({"seen_at": "datetime64[ns]"})


class Grants(InOrder):
    """Grants of a machine, from ``grant``, ``renew``, ``free`` and ``report`` actions and the changes of the machine.

    A grant is made only while the machine is up; its lease turns it into a zombie, which no renewal brings back and which a
    report that does not list it sweeps; freeing, replacing and the end of the machine end it as well."""

    columns = ["at", "event_id", "action", "grant_id", "lease_ms", "running"]
    out = ["servant", "grant_id", "granted_at", "at", "outcome", "renewals"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.up = handle.getValueState("up", "up boolean")
        self.held = handle.getMapState("held", "grant_id long", "granted_at long, until long, renewals long, zombie boolean")

    def rank(self, row):
        return row[0], row[1], _ORDER.get(row[2], 1)

    def parsed(self, row):
        at, event, action, grant, lease, running = row
        whole = lambda x: None if pd.isna(x) else int(x)
        return int(at), int(event), action, whole(grant), whole(lease), [] if running is None else [int(x) for x in running]

    def advance(self, key, due, horizon):
        up = bool(self.up.exists() and self.up.get()[0])
        before = {g[0]: tuple(v) for g, v in self.held.iterator()}
        held, made = dict(before), []

        def expire(until: int) -> None:
            for g, (granted, end, renewals, zombie) in sorted(held.items()):
                if not zombie and end < until:
                    held[g] = (granted, end, renewals, True)
                    made.append((key, g, granted, end, "zombie", renewals))

        def ends(g: int, at: int, outcome: str) -> None:
            granted, _, renewals, _ = held.pop(g)
            made.append((key, g, granted, at, outcome, renewals))

        for at, _, action, g, lease, running in due:
            expire(at)
            if action in _ORDER:
                up = action == "up"
                for x in [] if up else sorted(held):
                    ends(x, at, "orphaned")
            elif action == "report":
                for x in sorted(x for x, v in held.items() if v[3] and x not in running):
                    ends(x, at, "swept")
            elif g is None:
                continue
            elif action == "grant" and up:
                if g in held:
                    ends(g, at, "replaced")
                held[g] = (at, at + (lease or 0) * 1000, 0, False)
            elif action == "renew" and g in held and not held[g][3]:
                held[g] = (held[g][0], at + (lease or 0) * 1000, held[g][2] + 1, False)
            elif action == "free" and g in held:
                ends(g, at, "freed")
        expire(horizon + 1)
        self.up.update((up,))
        for g in before.keys() - held.keys():
            self.held.removeKey((g,))
        for g, v in held.items():
            if before.get(g) != v:
                self.held.updateValue((g,), v)
        return made, min((v[1] for v in held.values() if not v[3]), default=None)


def machine_changes(beats: DataFrame, slack: int = 2) -> DataFrame:
    """(servant, seen_at, at, event_id, change) of streamed heartbeats (servant, ts with a watermark, event_id, lease_ms).
    ``seen_at`` is the watermark at which the change of the time ``at`` was known, for operators that follow."""
    rows = beats.withColumn("at", F.unix_micros("ts"))
    zone = beats.sparkSession.conf.get("spark.sql.session.timeZone")
    return rows.groupBy("servant").transformWithStateInPandas(Uptimes(slack, zone), _CHANGES, "Append", "EventTime", eventTimeColumnName="seen_at")


def grant_ends(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """What ends the grants of each machine: (servant, grant_id, granted_at, at, outcome, renewals) with times in microseconds.

    ``events`` are streamed rows (servant, ts timestamp, event_id, action, grant_id, lease_ms, running array<long>); a
    ``report`` is also the machine's heartbeat with a lease of ``lease_ms``, 0 if it leaves.  A lease's end gives a ``zombie``
    row first.  Rows without machine or time are left out, unknown actions do nothing, a null lease is none, a null list is empty;
    a grant's state lasts as long as the grant."""
    known = events.where(F.col("servant").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    changes = machine_changes(known.where("action = 'report'").select("servant", "ts", "event_id", "lease_ms"))
    none = F.lit(None)
    as_action = changes.select("servant", F.col("seen_at").alias("ts"), "at", "event_id", F.col("change").alias("action"), none.cast("long").alias("grant_id"), none.cast("long").alias("lease_ms"), none.cast("array<long>").alias("running"))
    actions = known.where("action in ('grant', 'renew', 'free', 'report')").select("servant", "ts", F.unix_micros("ts").alias("at"), "event_id", "action", "grant_id", "lease_ms", "running")
    every = actions.union(as_action)
    return every.groupBy("servant").transformWithStateInPandas(Grants(5), _ENDS, "Append", "EventTime")
