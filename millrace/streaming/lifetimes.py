"""Lives of submitted and executing tasks as keyed state with timers, by event time or by the clock of the machine.

A submitter's task is queued, started, kept alive and done; an executor's task runs for the clients that share it.  A task has
at most one deadline: to be started, to be kept alive, or to be fetched.  What passes it ends the task.  By the clock the key
is the task; by event time tasks are dealt by hash over a number of groups, as a call for each task costs more than its rows.
No machine or digest gathers the tasks of others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.chained import InOrder

#: What a deadline that passes makes of a task in each phase.
PASSED = {"queued": "not_started", "running": "silent", "done": "dropped"}
_ENDED = "task_id long, born_at long, at long, outcome string, clients long"
_LIFE = "born_at long, phase string, deadline long, clients long"
_OUT = ["task_id", "born_at", "at", "outcome", "clients"]


class Life(NamedTuple):
    """A task that is held; times are microseconds, a null deadline never passes."""

    born_at: int
    phase: str
    deadline: int | None
    clients: int


class Rules(NamedTuple):
    """Milliseconds that a started task may go without a keep-alive and that a finished one is kept for its clients."""

    alive_ms: int
    keep_ms: int

    def overdue(self, life: Life | None, at: int) -> bool:
        return life is not None and life.deadline is not None and life.deadline < at

    def step(self, life: Life | None, at: int, action: str, start_ms: int) -> tuple[Life | None, str | None]:
        """The task after one action, and how it ended if it did; actions that do not fit its phase do nothing."""
        if life is None:
            if action == "queue":
                return Life(at, "queued", at + start_ms * 1000, 1), None
            return (Life(at, "running", None, 1) if action == "run" else None), None
        if action == "start" and life.phase == "queued":
            return life._replace(phase="running", deadline=at + self.alive_ms * 1000), None
        if action == "alive" and life.phase == "running" and life.deadline is not None:
            return life._replace(deadline=at + self.alive_ms * 1000), None
        if action == "done" and life.phase == "running":
            return life._replace(phase="done", deadline=at + self.keep_ms * 1000), None
        if action == "share" and life.phase != "queued":
            return life._replace(clients=life.clients + 1), None
        if action == "free" and life.phase != "queued":
            if life.clients > 1:
                return life._replace(clients=life.clients - 1), None
            return None, "killed" if life.phase == "running" else "freed"
        if action == "gone":
            return None, "orphaned"
        if action == "fetch" and life.phase == "done":
            return None, "fetched"
        return life, None


class LivesInOrder(InOrder):
    """Lives of a group of tasks by event time: rows wait for the watermark and are taken in order, so batches do not change results."""

    columns, out = ["at", "event_id", "action", "start_ms", "task_id"], _OUT

    def __init__(self, slack: int, rules: Rules):
        super().__init__(slack)
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lives = handle.getListState("lives", "rows binary")

    def rank(self, row):
        return row[4], row[0], row[1]

    def parsed(self, row):
        return int(row[0]), int(row[1]), row[2], 0 if pd.isna(row[3]) else int(row[3]), int(row[4])

    def advance(self, key, due, horizon):
        lives = {task: Life(*held) for packed in self.lives.get() for task, *held in pickle.loads(packed[0])} if self.lives.exists() else {}
        made, overdue = [], self.rules.overdue

        def passed(task, life):
            made.append((task, life.born_at, life.deadline, PASSED[life.phase], life.clients))

        for at, _, action, start, task in due:
            life = lives.pop(task, None)
            if overdue(life, at):
                passed(task, life)
                life = None
            after, outcome = self.rules.step(life, at, action, start)
            if outcome:
                made.append((task, life.born_at, at, outcome, life.clients))
            if after is not None:
                lives[task] = after
        for task in [task for task, life in lives.items() if overdue(life, horizon + 1)]:
            passed(task, lives.pop(task))
        if lives:
            self.lives.put(self._packed([(task, *life) for task, life in lives.items()]))
        else:
            self.lives.clear()
        return made, min((life.deadline for life in lives.values() if life.deadline is not None), default=None)


class LivesByClock(StatefulProcessor):
    """Lives by the time at which the rows of a batch are taken: deadlines come by processing-time timers, without a further row.

    State that no row touches for ``forget_ms`` ages away without an outcome: tasks that run without a deadline and whose
    executor is lost."""

    def __init__(self, rules: Rules, forget_ms: int):
        self.rules, self.forget_ms = rules, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", _LIFE, ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, made = timerValues.getCurrentProcessingTimeInMs() * 1000, []
        life = Life(*self.life.get()) if self.life.exists() else None
        before = life.deadline if life else None
        if self.rules.overdue(life, now):
            made.append((key[0], life.born_at, life.deadline, PASSED[life.phase], life.clients))
            life = None
        got = sorted((int(at), int(event), action, 0 if pd.isna(ms) else int(ms)) for pdf in rows for at, event, action, ms in pdf[LivesInOrder.columns[:4]].itertuples(index=False, name=None))
        for _, _, action, start in got:
            after, outcome = self.rules.step(life, now, action, start)
            if outcome:
                made.append((key[0], life.born_at, now, outcome, life.clients))
            life = after
        after = life.deadline if life else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            if after is not None:
                self.handle.registerTimer(after // 1000 + 1)
        self.life.clear() if life is None else self.life.update(tuple(life))
        yield pd.DataFrame(made, columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        life, made = Life(*self.life.get()) if self.life.exists() else None, []
        if self.rules.overdue(life, timerValues.getCurrentProcessingTimeInMs() * 1000):
            made.append((key[0], life.born_at, life.deadline, PASSED[life.phase], life.clients))
            self.life.clear()
        yield pd.DataFrame(made, columns=_OUT)

    def close(self) -> None:
        pass


def task_ends(events: DataFrame, *, alive_ms: int = 60_000, keep_ms: int = 60_000, late: str = "0 seconds", clock: str = "event",
              forget_ms: int = 86_400_000, groups: int = 1024) -> DataFrame:
    """How tasks end: (task_id, born_at, at, outcome, clients), times in microseconds, ``clients`` those that still hold it.

    ``events`` are streamed rows (task_id, ts timestamp, event_id, action, start_ms).  ``queue`` opens a submitter's task, which
    must see ``start`` within the row's ``start_ms``, then ``alive`` every ``alive_ms`` until ``done``, and ``fetch`` within
    ``keep_ms``: else it is not_started, silent or dropped.  ``run`` opens an executor's task, which has no deadline before
    ``done``; ``share`` adds a client, ``free`` takes one away and with the last one ends the task, killed if it still ran.
    ``gone`` (the submitter died) orphans it.  A deadline's very moment is still in time.

    ``clock`` is ``event`` (rows in order of time, with a watermark of ``late``) or ``processing`` (rows as they arrive, deadlines
    by the machine's clock, state without rows for ``forget_ms`` ages away); by event time tasks are held in ``groups``.  Rows without task or time are left out, a null
    ``start_ms`` is none, unknown actions and those that do not fit do nothing, and an ended id may be opened again."""
    known = events.where(F.col("task_id").isNotNull() & F.col("ts").isNotNull()).withColumn("at", F.unix_micros("ts"))
    known = known.select("task_id", "ts", "at", "event_id", F.coalesce("action", F.lit("")).alias("action"), "start_ms")
    rules = Rules(alive_ms, keep_ms)
    if clock == "processing":
        return known.groupBy("task_id").transformWithStateInPandas(LivesByClock(rules, forget_ms), _ENDED, "Append", "ProcessingTime")
    if clock != "event":
        raise ValueError(f"clock is event or processing, not {clock}")
    dealt = known.withWatermark("ts", late).withColumn("group", F.pmod(F.xxhash64("task_id"), F.lit(groups)))
    return dealt.groupBy("group").transformWithStateInPandas(LivesInOrder(1, rules), _ENDED, "Append", "EventTime")
