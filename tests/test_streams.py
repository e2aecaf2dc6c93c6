"""Lease streams against plain recomputations, over several batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.streaming import chained, leases, reuse, run

START = dt.datetime(2024, 5, 1)


def batches(spark, folder, rows, schema, n):
    """``rows`` as a stream of ``n`` files, one a batch, in order of time."""
    step = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def test_silent_machine_expires(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, at(0), 0), (1, at(5), 1), (2, at(6), 2), (2, at(16), 3), (3, at(20), 4), (2, at(40), 5), (3, at(45), 6)]
    got = run.available_now(leases.lease_stream(batches(spark, tmp_path / "in", rows, "servant long, ts timestamp, event_id long", 3), 10))
    assert sorted((r.servant, r.discovered_at, r.expires_at, r.beats) for r in got.collect()) == [
        (1, at(0), at(15), 2), (2, at(6), at(26), 2), (3, at(20), at(30), 1)]


def expected(rows):
    """Each machine's rows in order, with its grants in a dictionary."""
    held, out = {}, []
    for servant, ts, event, action, grant, lease, running in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = held.setdefault(servant, {})
        live = {g for g, (ends, dead) in mine.items() if not dead and ends >= ts}
        for g in mine:
            mine[g] = (mine[g][0], g not in live)
        ends = ts + dt.timedelta(milliseconds=lease)
        if action == "grant":
            mine[grant] = (ends, False)
            out.append((servant, grant, event, "granted"))
        elif action == "renew":
            if grant in live:
                mine[grant] = (ends, False)
            out.append((servant, grant, event, "renewed" if grant in live else "refused"))
        elif action == "free" and grant in mine:
            del mine[grant]
            out.append((servant, grant, event, "freed"))
        elif action == "report":
            out += [(servant, g, event, "unknown") for g in set(running) - live]
            gone = [g for g in mine if g not in live and g not in running]
            out += [(servant, g, event, "swept") for g in gone]
            for g in gone:
                del mine[g]
    return sorted(out)


def test_task_leases_match_a_plain_replay(spark, tmp_path):
    rng = random.Random(7)
    rows = [
        (rng.randrange(3), START + dt.timedelta(seconds=7 * i), i, rng.choice(["grant", "grant", "renew", "renew", "free", "report"]), rng.randrange(6), rng.randrange(1, 200) * 1000, rng.sample(range(8), 3))
        for i in range(400)
    ]
    schema = "servant long, ts timestamp, event_id long, action string, grant_id long, lease_ms long, running array<long>"
    got = run.available_now(leases.task_lease_stream(batches(spark, tmp_path / "in", rows, schema, 4))).collect()
    want = expected(rows)
    assert {w[3] for w in want} == {"granted", "renewed", "refused", "freed", "unknown", "swept"}
    assert sorted((r.servant, r.grant_id, r.event_id, r.outcome) for r in got) == want


def test_late_rows_count_within_the_watermark(spark, tmp_path):
    rows = [(START + dt.timedelta(hours=h), "a", 1) for h in (1, 30, 23, 90)]
    stream = batches(spark, tmp_path / "in", rows, "ts timestamp, kind string, k long", 4)
    got = run.available_now(leases.windowed_counts(stream, "12 hours")).select(F.col("window.start").alias("day"), "n")
    assert sorted(map(tuple, got.collect())) == [(START, 2), (START + dt.timedelta(days=1), 1)]


def plain_ends(rows, horizon):
    """One machine after the other, all of its rows in order, with the ends of leases and of the machine looked up at every step."""
    out = []
    for servant in {r[0] for r in rows}:
        mine = sorted((r[1], r[2], *r[3:]) for r in rows if r[0] == servant and r[1] <= horizon)
        moments, until, held = [*mine, (horizon, 1 << 62, "end", None, None, [])], None, {}
        for t, _, action, g, lease, running in moments:
            last = action == "end"
            if until is not None and (until < t or last and until <= t):
                for x, (granted, end, n, z) in sorted(held.items()):
                    if not z and end < until:
                        out.append((servant, x, granted, end, "zombie", n))
                    out.append((servant, x, granted, until, "orphaned", n))
                held, until = {}, None
            for x, (granted, end, n, z) in sorted(held.items()):
                if not z and (end < t or last and end <= t):
                    out.append((servant, x, granted, end, "zombie", n))
                    held[x] = (granted, end, n, True)
            lease = dt.timedelta(milliseconds=lease or 0)
            if action == "report":
                for x in [x for x, v in held.items() if v[3] and x not in (running or [])]:
                    granted, _, n, _ = held.pop(x)
                    out.append((servant, x, granted, t, "swept", n))
                if lease:
                    until = t + lease
                elif until is not None:
                    out += [(servant, x, v[0], t, "orphaned", v[2]) for x, v in held.items()]
                    held, until = {}, None
            elif action == "grant" and until is not None:
                if g in held:
                    out.append((servant, g, held[g][0], t, "replaced", held[g][2]))
                held[g] = (t, t + lease, 0, False)
            elif action == "renew" and g in held and not held[g][3]:
                held[g] = (held[g][0], t + lease, held[g][2] + 1, False)
            elif action == "free" and g in held:
                granted, _, n, _ = held.pop(g)
                out.append((servant, g, granted, t, "freed", n))
    return sorted(out)


def test_a_silent_machine_takes_its_grants(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i in range(420):
        action = rng.choice(["grant", "grant", "renew", "free", "report", "report", "other"])
        lease = rng.choice([0, 60, 900, None]) if action == "report" else rng.randrange(1, 600)
        rows.append((rng.choice([0, 1, 1, 2]), START + dt.timedelta(seconds=11 * i), i, action, rng.randrange(4), lease and lease * 1000, rng.choice([None, rng.sample(range(5), 2)])))
    rows += [(7, START + dt.timedelta(seconds=s), 1000 + s, a, 1, n * 1000, []) for s, a, n in ((1, "report", 100), (2, "grant", 900), (3, "grant", 5))]
    wide = [(None, START, 5000, "grant", 1, 5, []), (7, None, 5001, "grant", 1, 5, [])]
    schema = "servant long, ts timestamp, event_id long, action string, grant_id long, lease_ms long, running array<long>"
    got = run.available_now(chained.grant_ends(batches(spark, tmp_path / "in", sorted(rows, key=lambda r: r[1]) + wide, schema, 4))).collect()
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    want = plain_ends(rows, rows[419][1] - dt.timedelta(milliseconds=5))
    assert {w[4] for w in want} == {"zombie", "orphaned", "swept", "replaced", "freed"} and (7, 1, START + dt.timedelta(seconds=3), START + dt.timedelta(seconds=101), "orphaned", 0) in want
    assert sorted(map(tuple, got)) == sorted((s, g, micros(a), micros(b), o, n) for s, g, a, b, o, n in want)


def test_requests_reuse_what_is_in_flight(spark, tmp_path):
    rng = random.Random(8)
    at = lambda m: START + dt.timedelta(minutes=m)
    runs = [(i, rng.choice(["a", "b", None]), at(5 * i), at(5 * i + rng.randrange(0, 200))) for i in range(120)]
    reports = sorted(((g, d, b, e, b + dt.timedelta(minutes=m)) for g, d, b, e in runs for m in rng.choice([(0,), (0, 7), (0, 30, 50)])), key=lambda r: r[4])
    asked = [(i, rng.choice(["a", "b", "c", None]), at(3 * i + 1)) for i in range(210)]
    stream = lambda name, rows, schema: batches(spark, tmp_path / name, rows, schema, 3)
    got = run.available_now(reuse.in_flight(
        stream("q", [*asked, (999, "a", at(3000))], "request_id long, digest string, ts timestamp"),
        stream("r", [*reports, (999, "z", at(3000), at(3001), at(3000))], "grant_id long, digest string, started_at timestamp, ends_at timestamp, seen timestamp")))
    want = {}
    for i, d, t in asked:
        live = [(b, g) for g, x, b, e in runs if d is not None and x == d and b <= t < e]
        want[i] = max(live)[1] if live else None
    assert {r.request_id: r.reused_grant for r in got.collect()} == want
    assert {r.outcome for r in got.collect()} == {"reuse_existing", "actually_run"}


def test_requests_meet_runs_without_pairs(spark, tmp_path):
    """One busy digest: no join holds requests against runs; runs over several spans, equal starts and repeated requests count once."""
    rng = random.Random(3)
    at = lambda m: START + dt.timedelta(seconds=m)
    runs = [(i, "a", at(i // 2 * 40), at(i // 2 * 40 + rng.choice([0, 20, 900, 43_200]))) for i in range(2000)]
    asked = [(i, "a", at(i // 2 * 37 + 3)) for i in range(2000)]
    flow = reuse.in_flight(
        batches(spark, tmp_path / "q", [*asked, *asked[-5:], (-1, "a", at(400_000))], "request_id long, digest string, ts timestamp", 2),
        batches(spark, tmp_path / "r", [*[(*r, r[2]) for r in runs], (-1, "z", at(400_000), at(400_001), at(400_000))], "grant_id long, digest string, started_at timestamp, ends_at timestamp, seen timestamp", 2))
    assert "Join" not in flow._jdf.queryExecution().analyzed().toString()
    got = [(r.request_id, r.reused_grant) for r in run.available_now(flow).collect()]
    assert sorted(got) == [(i, max(((b, g) for g, _, b, e in runs if b <= t < e), default=(None, None))[1]) for i, _, t in asked]


def test_streams_side_by_side(spark, tmp_path):
    """Two at once: both have their state, and the session's settings and the state folders are as before."""
    import os
    from concurrent.futures import ThreadPoolExecutor

    key, root = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, there = spark.conf.get(key, None), set(os.listdir(root))
    rows = [(i % 2, START + dt.timedelta(seconds=i), i) for i in range(30)]
    streams = [leases.lease_stream(batches(spark, tmp_path / x, rows, "servant long, ts timestamp, event_id long", 3), 1) for x in "ab"]
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(run.available_now, streams)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []
    assert spark.conf.get(key, None) == before
    new = [x for x in os.listdir(root) if x not in there and x.startswith("stream-")]
    assert len(new) == 2 and all(os.listdir(f"{root}/{x}") == ["out"] for x in new)
