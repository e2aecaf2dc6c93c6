"""Jobs' files and messages, dumps of machines, holders that are gone, and reports of the system, on small tables."""

from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import arguments, machines
from millrace.operators import cache, jobs
from tests.test_golden import one

NOON = datetime(2024, 1, 1, 12)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def at(seconds):
    return NOON + timedelta(seconds=seconds)


def now():
    return F.expr("timestamp_ntz'2024-01-01 12:00:00'")


def test_files_of_a_job_go_out_and_come_back(spark):
    path = b"/w/1/out.o\0"
    files = spark.createDataFrame(
        [("/w/1/out.o", b"ab" + path + b"x" + path), ("/w/1/out.d/x", b""), ("/w/1/core", b"?"), ("/w/2/out.o", b"zz"), ("/w/3/out.o", None), ("/w/top", b""), ("/v/1/out.o", b""), (None, b"")],
        "path string, content binary",
    )
    got = jobs.collected(files, "/w/")
    assert rows(got.select("job", "name")) == [("1", "core"), ("1", "out.d/x"), ("1", "out.o"), ("2", "out.o"), ("3", "out.o")]
    listed = {r["job"]: (r["files"], r["bytes"], r["names"]) for r in jobs.manifest(got).collect()}
    assert listed == {"1": (3, 26, ["core", "out.d/x", "out.o"]), "2": (1, 2, ["out.o"]), "3": (1, None, ["out.o"])}

    results = spark.createDataFrame([("1", 0), ("2", 1), ("3", 0), ("4", 0), ("5", -1)], "job string, exit_code int")
    sent = jobs.out_of_band(got, results, "out", F.concat(F.lit("/w/"), "job")).cache()
    places = {(r["job"], r["suffix"]): r["places"] and [tuple(p) for p in r["places"]] for r in sent.where("error is null").collect()}
    assert places == {("1", ".o"): [(2, 10, 2), (14, 10, 2)], ("1", ".d/x"): [], ("3", ".o"): []}
    assert rows(sent.where("error is not null").select("job", "suffix", "error")) == [("1", None, "unexpected file core")]

    extra = jobs.packed(sent)
    came = spark.createDataFrame([("1", ".o"), ("1", ".new"), ("2", ".o"), ("3", ".o"), ("5", ".o")], "job string, suffix string")
    told = results.join(extra, "job", "left").withColumn("extra", F.when(F.col("job") == "3", "{").otherwise(F.col("extra")))
    back = {(r["job"], r["suffix"]): (r["exit_code"], r["error"], r["patches"] and [tuple(p) for p in r["patches"]]) for r in jobs.rebuilt(told, came).collect()}
    assert back == {
        ("1", ".o"): (0, None, [(2, 10, 2), (14, 10, 2)]), ("1", ".new"): (0, None, []), ("2", ".o"): (1, None, []),
        ("3", None): (0, "malformed message", None), ("4", None): (0, "malformed message", None), ("5", None): (-1, None, None),
    }


def test_last_report_counts(spark):
    schema = "servant long, ts timestamp_ntz, event_id long, running array<struct<grant_id:long,digest:string>>"
    reports = spark.createDataFrame(
        [(1, at(-9), 1, [(1, "a"), (2, "b")]), (1, at(-5), 2, [(2, "b"), (3, None)]), (1, at(5), 3, [(9, "z")]), (2, at(-10), 4, [(4, "d")]), (3, at(-1), 5, [(5, "e")]), (3, at(-1), 6, []),
         (4, at(-1), 7, None), (5, at(0), 8, [(6, "f")])], schema)
    assert rows(jobs.running_tasks(reports, now(), "10 seconds")) == [(1, 2, "b"), (1, 3, None), (5, 6, "f")]
    assert rows(jobs.running_tasks(reports.limit(0), now(), "10 seconds")) == []


def test_dump_of_a_machine(spark):
    schema = "servant long, task_id long, started_at timestamp_ntz, completed_at timestamp_ntz, exit_code int"
    runs = spark.createDataFrame(
        [(1, 1, at(-100), at(-60), 0), (1, 2, at(-100), at(-59), 1), (1, 3, at(-5), at(0), 2), (1, 4, at(-5), at(1), 3), (1, 5, at(-5), None, None), (1, 6, at(1), None, None), (3, 7, at(0), at(9), 0)], schema)
    limits = spark.createDataFrame([(1, 8), (2, 4)], "servant long, max_tasks long")
    assert rows(jobs.engine_dump(limits, runs, now(), "60 seconds")) == [(1, 8, 2, 4, 5), (2, 4, 0, 0, 0), (3, None, 1, 1, 1)]
    alive = jobs.alive_tasks(runs, now(), "60 seconds").select("task_id", "state", "completed_at", "exit_code")
    assert rows(alive) == [(2, "DONE", at(-59), 1), (3, "DONE", at(0), 2), (4, "RUNNING", None, None), (5, "RUNNING", None, None), (7, "RUNNING", None, None)]
    assert rows(jobs.engine_dump(limits, runs.limit(0), now(), "60 seconds")) == [(1, 8, 0, 0, 0), (2, 4, 0, 0, 0)]


def test_holders_that_are_gone(spark):
    holders = spark.createDataFrame([(1, 1, at(0.25)), (1, 2, at(0.25)), (1, 3, at(2)), (1, 4, at(0)), (2, 1, at(0))], "servant long, pid long, since timestamp_ntz")
    seen = spark.createDataFrame([(1, 1, at(0), "X"), (1, 1, at(1), "R"), (1, 2, at(3.5), "Z"), (1, 2, at(3), "S"), (1, 3, at(1), "x"), (2, 1, at(7), None)], "servant long, pid long, ts timestamp_ntz, state string")
    assert rows(jobs.reclaimed(holders, seen)) == [(1, 2, at(4), "Z"), (1, 3, at(2), "x"), (1, 4, at(0), None), (2, 1, at(7), None)]


def test_keys_worth_asking(spark):
    wanted = spark.createDataFrame([("a", at(0), at(-1)), ("b", at(0), at(-1)), ("b", at(0), at(-600)), ("b", at(0), None), (None, at(0), at(-1))], "key string, asked_at timestamp_ntz, filter_at timestamp_ntz")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    asked = [(r["key"], r["filter_at"], r["ask"]) for r in cache.worth_asking(wanted, keys).collect()]
    assert sorted(asked, key=str) == sorted([("a", at(-1), True), ("b", at(-1), False), ("b", at(-600), True), ("b", None, True), (None, at(-1), False)], key=str)


def test_reports_of_the_system(spark):
    memory = machines.memory_report(F.col("t"))
    got = one(spark, memory, t="MemTotal:   12 kB\nMemFree: x\nxMemFree: 4\nMemAvailable:\t7 kB\nMemAvailable: 9\nCached 3\nSwapFree: -2")
    assert got.asDict() == {"mem_total": 12, "mem_free": 0, "mem_available": 9, "buffers": 0, "cached": 0, "swap_total": 0, "swap_free": -2}
    assert one(spark, machines.idle_seconds(F.col("t")), t="cpu  1 2 3 450 5\ncpu0 9 9 9 9") == 4.5
    assert [one(spark, machines.idle_seconds(F.col("t")), t=t) for t in ("", "cpu 1 2 3 0", "cpu 1 2")] == [None] * 3
    assert [one(spark, machines.load_last_minute(F.col("t")), t=t) for t in ("0.31 0.2", "2 1", "2.00", "x", "")] == [1, 2, 2, None, None]
    quota = machines.quota_processors(F.col("q"), F.col("p"), F.lit(8))
    assert [one(spark, quota, q=q, p=p) for q, p in ((250, 100), (5000, 100), (-1, 100), (100, 0), (50, 100))] == [2, 8, None, None, 0]


WORDS = st.sampled_from(["-c", "-o", "-I", "-D", "-x", "-", "a.cc", "", "O", "-MF", None])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=12), min_size=1, max_size=40))
def test_parse_like_a_loop(spark, lines):
    def plain(argv):
        options, files, i = [], [], 0
        while i < len(argv):
            w = argv[i]
            if w in arguments.ONE_VALUE:
                options.append((w, argv[i + 1 : i + 2]))
                i += 1
            elif w is not None and w.startswith("-"):
                options.append((w, []))
            else:
                files.append(w)
            i += 1
        return options, files

    df = spark.createDataFrame([(x,) for x in lines], "argv array<string>").select("argv", arguments.parse(F.col("argv")).alias("p"))
    for r in df.collect():
        assert ([(o["opt"], o["args"]) for o in r["p"]["options"]], r["p"]["files"]) == plain(r["argv"])
