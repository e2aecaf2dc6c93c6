"""Moments, held tasks, as-of rows and matched queues against plain loops, with nulls, ties, hot keys and empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import timeline

START = dt.datetime(2024, 5, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def rng():
    return random.Random(11)


def moment(rng, span=9000):
    return rng.choice([None, *[rng.randrange(span) for _ in range(30)]])


@pytest.mark.parametrize("bucket", [3600, 10**7])
def test_held_at(spark, rng, bucket, monkeypatch):
    monkeypatch.setattr(timeline, "FAN", 4)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    tasks = [(key(), at(moment(rng)), at(moment(rng))) for _ in range(300)]
    asked = [(i, key(), at(moment(rng))) for i in range(200)]
    t = spark.createDataFrame(tasks, "servant long, began timestamp, ended timestamp")
    r = spark.createDataFrame(asked, "id long, servant long, ts timestamp")
    got = timeline.held_at(r, t, ["servant"], at="ts", start="began", end="ended", bucket=bucket)
    want = {i: None if k is None or ts is None else sum(k == x and b is not None and b <= ts and (e is None or ts < e) for x, b, e in tasks) for i, k, ts in asked}
    assert {r.id: r.held for r in got.collect()} == want
    assert {r.held for r in timeline.held_at(r, t.limit(0), ["servant"], at="ts", start="began", end="ended").collect()} == {0, None}


def test_admission(spark):
    r = spark.createDataFrame([(1, 4), (1, 3), (2, 0), (3, 0)], "servant long, held long")
    limits = spark.createDataFrame([(1, 4, 2), (2, 8, 1)], "servant long, max_tasks long, memory_available_gib long")
    assert sorted((x.servant, x.held, x.admitted) for x in timeline.admitted(r, limits, ["servant"]).collect()) == [(1, 3, True), (1, 4, False), (2, 0, False), (3, 0, False)]


@pytest.mark.parametrize("bucket", [3600, 10**7])
def test_as_of(spark, rng, bucket, monkeypatch):
    monkeypatch.setattr(timeline, "FAN", 4)
    key = lambda: rng.choice([1, 1, 1, 2, None])
    shots = [(i, key(), at(moment(rng)), rng.choice([None, i])) for i in range(150)]
    asked = [(i, key(), at(moment(rng))) for i in range(200)]
    right = spark.createDataFrame(shots, "shot long, servant long, ts timestamp, value long")
    left = spark.createDataFrame(asked, "id long, servant long, ts timestamp")
    for fresh in (None, "200 minutes") if bucket == 3600 else ("200 minutes",):
        want = {}
        for i, k, ts in asked:
            good = [s for s in shots if ts is not None and k is not None and s[2] is not None and s[1] == k and s[2] <= ts and (not fresh or s[2] >= ts - dt.timedelta(minutes=200))]
            best = max(good, key=lambda s: (s[2], s[0]), default=None)
            want[i] = (best[0], best[3]) if best else None
        got = timeline.as_of(left, right, ["servant"], at="ts", order="shot", fresh=fresh, bucket=bucket).collect()
        assert {r.id: (r.seen.shot, r.seen.value) if r.seen else None for r in got} == want
    assert [r.seen for r in timeline.as_of(left, right.limit(0), ["servant"], at="ts", order="shot").collect()] == [None] * 200


def replay(waiters, grants, life):
    """One queue after the other, one waiter at a time."""
    out = {w: None for w, _, _ in waiters}
    for key in {k for _, k, _ in waiters} - {None}:
        queue = sorted((ts, g) for g, k, ts in grants if k == key and ts is not None)
        for ts, w in sorted((ts, w) for w, k, ts in waiters if k == key and ts is not None):
            queue = [x for x in queue if x[0] + life > ts]
            if queue and queue[0][0] <= ts:
                out[w] = queue.pop(0)[1]
    return out


@pytest.mark.parametrize(("run", "span"), [(512, 4000), (5, 60)])
def test_queues(spark, rng, run, span, monkeypatch):
    monkeypatch.setattr(timeline, "RUN", run)
    key = lambda: rng.choice([1, 1, 1, 2, None])
    waiters = [(i, key(), at(moment(rng, span))) for i in range(120)]
    grants = [(1000 + i, key(), at(moment(rng, span))) for i in range(130)]
    w = spark.createDataFrame(waiters, "waiter_id long, servant long, ts timestamp")
    g = spark.createDataFrame(grants, "grant_id long, servant long, ts timestamp")
    for minutes in (25, 100_000):
        want = replay(waiters, grants, dt.timedelta(minutes=minutes))
        got = {r.waiter_id: r.grant_id for r in timeline.match_queues(w, g, ["servant"], at="ts", lifetime=f"{minutes} minutes", bucket=3600).collect()}
        assert got == want
        assert minutes < 1000 or sum(v is not None for v in want.values()) > 5
    assert all(r.grant_id is None for r in timeline.match_queues(w, g.limit(0), ["servant"], at="ts", lifetime="1 minute").collect())


def test_waiters_of_one_moment_are_one_step(spark, monkeypatch):
    waiters = [(i, 1, at(10 * (i % 3))) for i in range(600)]
    grants = [(1000 + i, 1, at(i % 25)) for i in range(400)]
    w = spark.createDataFrame(waiters, "waiter_id long, servant long, ts timestamp")
    g = spark.createDataFrame(grants, "grant_id long, servant long, ts timestamp")
    made, fold = [], timeline._gone_before
    monkeypatch.setattr(timeline, "_gone_before", lambda steps, *rest: made.append(steps.count()) or fold(steps, *rest))
    for minutes in (4, 15, 100):
        got = {r.waiter_id: r.grant_id for r in timeline.match_queues(w, g, ["servant"], at="ts", lifetime=f"{minutes} minutes", bucket=3600).collect()}
        assert got == replay(waiters, grants, dt.timedelta(minutes=minutes))
    assert made == [3, 3, 3]


def running_rows(rng):
    """Nulls, ties and a hot key."""
    return [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), at(moment(rng)), rng.choice([None, *range(-3, 9)])) for i in range(250)]


@pytest.mark.parametrize("bucket", [3600, 10**7])
def test_running_values(spark, rng, bucket, monkeypatch):
    monkeypatch.setattr(timeline, "FAN", 4)
    rows = running_rows(rng)
    df = spark.createDataFrame(rows, "event_id long, servant long, ts timestamp, k long")
    how = {"at": "ts", "order": "event_id", "bucket": bucket}
    upto = lambda r: [x for x in sorted(rows, key=lambda x: (x[2] or START, x[0])) if x[1] == r[1] and x[2] is not None and (x[2], x[0]) <= (r[2], r[0])]
    whole = [r for r in rows if r[1] is not None and r[2] is not None]
    sums = {r.event_id: r.s for r in timeline.running_sum(df, ["servant"], value=F.col("k"), name="s", **how).collect()}
    assert sums == {r[0]: sum(x[3] or 0 for x in upto(r)) if r in whole else None for r in rows}
    last = {r.event_id: r.v for r in timeline.running_last(df, ["servant"], value=F.col("k"), name="v", **how).collect()}
    known = {r[0]: [x[3] for x in upto(r) if x[3] is not None] if r in whole else [] for r in rows}
    assert last == {i: v[-1] if v else None for i, v in known.items()}
    places = {r.event_id: r.n for r in timeline.numbered(df, ["servant"], name="n", **how).collect()}
    assert places == {r[0]: len(upto(r)) for r in whole}
    before = {r.event_id: r.b for r in timeline.earlier(df, ["servant"], value="k", name="b", back=5, **how).collect()}
    assert before == {r[0]: upto(r)[-6][3] if len(upto(r)) > 5 else None for r in whole}
    assert timeline.running_sum(df.limit(0), ["servant"], value=F.col("k"), name="s", **how).count() == 0


@pytest.mark.parametrize("bucket", [3600, 10**7])
def test_uptimes(spark, rng, bucket, monkeypatch):
    monkeypatch.setattr(timeline, "FAN", 4)
    rows = running_rows(rng)
    df = spark.createDataFrame(rows, "event_id long, servant long, ts timestamp, k long")
    got = timeline.uptimes(df, ["servant"], at="ts", gap="90 minutes", bucket=bucket)
    want = []
    for key in (1, 2, 3):
        runs = []
        for t in sorted(r[2] for r in rows if r[1] == key and r[2] is not None):
            if not runs or t - runs[-1][-1] > dt.timedelta(minutes=90):
                runs.append([])
            runs[-1].append(t)
        want += [(key, i, r[0], r[-1], len(r)) for i, r in enumerate(runs)]
    assert len(want) > 9 and sorted(tuple(r) for r in got.select("servant", "session", "first", "last", "n").collect()) == want
