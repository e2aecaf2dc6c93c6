"""Requests that join a task already in flight, over two streams: requests and the reports of running tasks.

Both are dealt by digest and span of time, a run to each span that it touches, and a span is swept in order of time with the
running tasks in a heap.  So work grows with the rows, and not with the pairs of requests and runs of a digest.
"""

from __future__ import annotations

import heapq
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from millrace.streaming.chained import InOrder


def _micros(interval: str):
    return F.unix_micros(F.expr(f"timestamp_seconds(0) + interval {interval}"))


class Reuse(InOrder):
    """Requests of a digest and span with the run that they find: the one that started last of those that run.

    Rows are (at, id, started, until) with a null ``started`` for a request, which comes after the runs of its moment."""

    columns, out = ["at", "id", "started", "until"], ["asked", "request_id", "at", "reused_grant"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.running = handle.getValueState("running", "runs binary")

    def rank(self, row):
        return row[0], row[2] is None, row[1]

    def parsed(self, row):
        at, own, started, until = row
        return int(at), int(own), None if started != started or started is None else int(started), None if until != until or until is None else int(until)

    def advance(self, key, due, horizon):
        heap = pickle.loads(self.running.get()[0]) if self.running.exists() else []
        made, last = [], None
        for row in due:
            at, own, started, until = row
            if started is not None:
                heapq.heappush(heap, (-started, -own, until))
            elif row != last:
                while heap and heap[0][2] <= at:
                    heapq.heappop(heap)
                made.append((key, own, at, -heap[0][1] if heap else None))
            last = row
        heap = sorted(r for r in heap if r[2] > horizon)
        if heap:
            self.running.update((pickle.dumps(heap),))
        elif self.running.exists():
            self.running.clear()
        return made, min((r[2] for r in heap), default=None)

    def framed(self, made, now):
        return super().framed(made, now).astype({"reused_grant": "Int64"})


def in_flight(requests: DataFrame, reports: DataFrame, *, late: str = "1 hour", longest: str = "12 hours") -> DataFrame:
    """(request_id, ts, digest, reused_grant, outcome): what each streamed request (request_id, digest, ts timestamp) finds.

    ``reports`` (grant_id, digest, started_at, ends_at, seen timestamp) tell of running tasks, each of them several times
    within ``late`` and with the same values; a task runs ``longest`` at most and is first seen within ``late`` of its start.
    A request reuses the task with its digest that started last and runs at that time, ``started_at <= ts < ends_at`` (of
    equal ones the largest grant), else it runs itself.  The answer comes once the watermark, ``late`` behind the newest row
    of the slower stream, is ``longest`` past the request.  Null digests reuse nothing; rows without a time are left out, ids
    are whole numbers, and ``late`` is at most ``longest``."""
    spark = requests.sparkSession
    slack, wait = (r // 1000 for r in spark.range(1).select(_micros(longest).alias("a"), _micros(late).alias("b")).first())
    if wait > slack:
        raise ValueError("late is at most longest")
    span = F.lit(slack * 500)  # half of the longest run in microseconds: a run touches three spans at most
    kind = requests.schema["digest"].dataType
    seen = reports.where(F.col("seen").isNotNull()).withWatermark("seen", late).dropDuplicatesWithinWatermark(["grant_id"])
    start = F.greatest(F.unix_micros("started_at"), F.unix_micros("seen") - wait * 1000)
    until = F.least(F.unix_micros("ends_at"), F.unix_micros("seen") + slack * 1000 + 1)
    runs = seen.where(F.col("started_at").isNotNull() & F.col("ends_at").isNotNull() & F.col("digest").isNotNull()).select(
        F.col("seen").alias("when"), F.col("digest").cast(kind).cast("string").alias("asked"), start.alias("at"), F.col("grant_id").cast("long").alias("id"), F.unix_micros("started_at").alias("started"), until.alias("until"))
    runs = runs.where("at < until").withColumn("span", F.explode(F.sequence(F.floor(F.col("at") / span), F.floor((F.col("until") - 1) / span))))
    none = F.lit(None).cast("long")
    asked = requests.where(F.col("ts").isNotNull()).withWatermark("ts", late).select(
        F.col("ts").alias("when"), F.col("digest").cast("string").alias("asked"), F.unix_micros("ts").alias("at"), F.col("request_id").cast("long").alias("id"), none.alias("started"), none.alias("until"))
    asked = asked.withColumn("span", F.floor(F.col("at") / span))
    # a key is never null: other digests have a mark before them
    rows = asked.unionByName(runs).withColumn("key", F.concat(F.col("span").cast("string"), F.coalesce(F.concat(F.lit("="), "asked"), F.lit(""))))
    got = rows.groupBy("key").transformWithStateInPandas(Reuse(slack), "asked string, request_id long, at long, reused_grant long", "Append", "EventTime")
    digest = F.when(F.instr("asked", "=") > 0, F.expr("substring(asked, instr(asked, '=') + 1)")).cast(kind)
    outcome = F.when(F.col("reused_grant").isNull(), "actually_run").otherwise("reuse_existing")
    return got.select("request_id", F.timestamp_micros("at").alias("ts"), digest.alias("digest"), "reused_grant", outcome.alias("outcome"))
