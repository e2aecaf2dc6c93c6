"""Lives of tasks over streams: against a plain replay by event time, and by the machine's clock."""

import datetime as dt
import random
import time

import pytest

from millrace.streaming import lifetimes, run
from tests.test_streams import START, batches

SCHEMA = "task_id long, ts timestamp, event_id long, action string, start_ms long"
ACTIONS = ["queue", "queue", "run", "start", "start", "alive", "share", "free", "done", "done", "fetch", "gone", None]
HOUR = dt.timedelta(hours=1)


def plain(rows, horizon, alive, keep):
    """Each task's rows in order; what is held is a dictionary with the name and the moment of its deadline."""
    out = []
    for task in {r[0] for r in rows}:
        mine, held = sorted((r for r in rows if r[0] == task and r[1] <= horizon), key=lambda r: (r[1], r[2])), {}
        for _, t, _, action, start in [*mine, (task, horizon + dt.timedelta(microseconds=1), 0, "end", 0)]:
            end = lambda at, how: (out.append((task, held["born"], at, how, held["n"])), held.clear())  # noqa: B023, E731
            if held and held["late"] and held["until"] < t:
                end(held["until"], held["late"])
            until = t + dt.timedelta(milliseconds=start or 0)
            if not held:
                if action in ("queue", "run"):
                    held.update(born=t, n=1, until=until, late="not_started" if action == "queue" else None, runs=action == "run", over=False)
            elif action == "start" and not held["runs"] and not held["over"]:
                held.update(runs=True, until=t + alive, late="silent")
            elif action == "alive" and held["late"] == "silent":
                held["until"] = t + alive
            elif action == "done" and held["runs"]:
                held.update(runs=False, over=True, until=t + keep, late="dropped")
            elif action == "gone":
                end(t, "orphaned")
            elif action == "fetch" and held["over"]:
                end(t, "fetched")
            elif action in ("share", "free") and (held["runs"] or held["over"]):
                held["n"] += 1 if action == "share" else -1
                if not held["n"]:
                    held["n"] = 1
                    end(t, "killed" if held["runs"] else "freed")
    return sorted(out)


def test_lives_match_a_plain_replay(spark, tmp_path):
    rng = random.Random(15)
    rows = [(rng.randrange(6), START + dt.timedelta(minutes=10 * i), i, rng.choice(ACTIONS), rng.choice([None, 3_600_000, 7_200_000])) for i in range(900)]
    rows += [(50, START, 2000, "queue", 7_200_000), (50, START + 2 * HOUR, 2001, "start", None), (51, START, 2002, "queue", 7_199_999), (51, START + 2 * HOUR, 2003, "start", None)]
    odd = [(None, START, 3000, "queue", 5), (52, None, 3001, "queue", 5)]
    stream = batches(spark, tmp_path / "in", sorted(rows, key=lambda r: (r[1], r[2])) + odd, SCHEMA, 4)
    got = run.available_now(lifetimes.task_ends(stream, alive_ms=2 * 3_600_000, keep_ms=4 * 3_600_000)).collect()
    want = plain(rows, rows[899][1] - dt.timedelta(milliseconds=1), 2 * HOUR, 4 * HOUR)
    assert {w[3] for w in want} == {"not_started", "silent", "dropped", "killed", "freed", "orphaned", "fetched"}
    assert [w[3] for w in want if w[0] == 50] == ["silent"] and [w[3] for w in want if w[0] == 51] == ["not_started"]
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert sorted(map(tuple, got)) == sorted((k, micros(b), micros(t), o, n) for k, b, t, o, n in want)


def test_groups_hold_several_tasks(spark, tmp_path):
    rng = random.Random(15)
    rows = [(rng.randrange(6), START + dt.timedelta(minutes=10 * i), i, rng.choice(ACTIONS), rng.choice([None, 3_600_000, 7_200_000])) for i in range(900)]
    rows += [(50, START, 2000, "queue", 7_200_000), (50, START + 2 * HOUR, 2001, "start", None), (51, START, 2002, "queue", 7_199_999), (51, START + 2 * HOUR, 2003, "start", None)]
    odd = [(None, START, 3000, "queue", 5), (52, None, 3001, "queue", 5)]
    stream = batches(spark, tmp_path / "in", sorted(rows, key=lambda r: (r[1], r[2])) + odd, SCHEMA, 4)
    got = run.available_now(lifetimes.task_ends(stream, alive_ms=2 * 3_600_000, keep_ms=4 * 3_600_000, groups=2)).collect()
    want = plain(rows, rows[899][1] - dt.timedelta(milliseconds=1), 2 * HOUR, 4 * HOUR)
    assert {w[3] for w in want} == {"not_started", "silent", "dropped", "killed", "freed", "orphaned", "fetched"}
    assert [w[3] for w in want if w[0] == 50] == ["silent"] and [w[3] for w in want if w[0] == 51] == ["not_started"]
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert sorted(map(tuple, got)) == sorted((k, micros(b), micros(t), o, n) for k, b, t, o, n in want)


def test_deadlines_pass_by_the_clock_and_state_ages(spark, tmp_path):
    """Three batches, then none: deadlines still pass, and the task that only runs is forgotten."""
    at = lambda i: START + dt.timedelta(seconds=i)
    rows = [(1, at(0), 0, "queue", 500), (2, at(1), 1, "queue", 600_000), (3, at(2), 2, "run", None), (4, at(3), 3, "run", None),
            (2, at(4), 4, "start", None), (4, at(5), 5, "share", None), (5, at(6), 6, "run", None), (5, at(7), 7, "free", None),
            (4, at(8), 8, "done", None), (6, at(9), 9, "run", None), (6, at(10), 10, "gone", None), (7, at(11), 11, None, None)]
    stream = lifetimes.task_ends(batches(spark, tmp_path / "in", rows, SCHEMA, 3), alive_ms=700, keep_ms=800, clock="processing", forget_ms=6_000)
    writer = stream.writeStream.format("memory").queryName("lives").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    query = run.start(spark, writer.trigger(processingTime="300 milliseconds"))
    want, stop = {(1, "not_started"), (2, "silent"), (4, "dropped"), (5, "killed"), (6, "orphaned")}, time.time() + 90
    while time.time() < stop and spark.table("lives").count() < len(want):
        time.sleep(0.5)
    time.sleep(8)
    # task 3 has been forgotten by now, so its client has nothing to free; task 8 shows that the batch was read
    more = [(3, at(100), 100, "free", None), (8, at(101), 101, "run", None), (8, at(102), 102, "free", None)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want.add((8, "killed"))
    while time.time() < stop and spark.table("lives").count() < len(want):
        time.sleep(0.5)
    assert query.exception() is None
    got = spark.table("lives").collect()
    query.stop()
    assert sorted((r.task_id, r.outcome) for r in got) == sorted(want)
    assert {r.task_id: r.clients for r in got}[4] == 2 and all(r.at >= r.born_at for r in got)


def test_an_unknown_clock_is_an_error(spark):
    with pytest.raises(ValueError, match="clock"):
        lifetimes.task_ends(spark.createDataFrame([], SCHEMA), clock="sun")
