"""The cache tree as a source and sink, and its key log as a stream, on real folders."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from millrace.sources import cache_tree


@pytest.fixture(autouse=True)
def known(spark):
    cache_tree.register(spark)


def entries(spark, rows):
    return spark.createDataFrame(rows, "key string, value binary, extra int").repartition(3)


def read(spark, root, **options):
    return spark.read.format("millrace_cache").options(path=str(root), **options).load()


def test_round_trip_and_newest_batch(spark, tmp_path):
    rows = [(f"k/{i} é", b"v" * i, i) for i in range(60)]
    entries(spark, [*rows, (None, b"x", 1), ("none", None, 1)]).write.format("millrace_cache").option("path", str(tmp_path)).mode("append").save()
    assert {r.key: (bytes(r.value), r.size) for r in read(spark, tmp_path).collect()} == {k: (v, len(v)) for k, v, _ in rows}
    entries(spark, [("k/3 é", b"new", 0)]).write.format("millrace_cache").option("path", str(tmp_path)).mode("append").save()
    got = {r.key: (r.value, r.size) for r in read(spark, tmp_path, values="false").collect()}
    assert len(got) == 60 and got["k/3 é"] == (None, 3)
    entries(spark, [("only", b"one", 0)]).write.format("millrace_cache").option("path", str(tmp_path)).mode("overwrite").save()
    assert [r.key for r in read(spark, tmp_path).collect()] == ["only"]
    assert not [x for x in os.listdir(tmp_path) if x.startswith(".")]
    assert read(spark, tmp_path / "missing").collect() == []


def test_filters_reach_the_source(spark, tmp_path):
    entries(spark, [(f"{p}-{i}", b"v", i) for p in "ab" for i in range(20)]).write.format("millrace_cache").option("path", str(tmp_path)).mode("append").save()
    reader = cache_tree.TreeReader(str(tmp_path), True)
    assert list(reader.pushFilters([EqualTo(("key",), "a-1"), EqualTo(("size",), 3)])) == [EqualTo(("size",), 3)]
    (part,) = reader.partitions()
    assert part.folders == cache_tree.place("a-1") and [x[0] for x in reader.read(part)] == ["a-1"]
    reader = cache_tree.TreeReader(str(tmp_path), True)
    assert list(reader.pushFilters([In(("key",), ("a-1", "b-2", "zz")), StringStartsWith(("key",), "b")])) == []
    assert [x[0] for p in reader.partitions() for x in reader.read(p)] == ["b-2"]
    assert sorted(r.key for r in read(spark, tmp_path).where(F.col("key").isin("a-3", "b-19", "c")).collect()) == ["a-3", "b-19"]
    assert read(spark, tmp_path).where("key = 'a-7' and size = 1").count() == 1
    assert read(spark, tmp_path).where("key like 'b-1%'").count() == 11
    plan = read(spark, tmp_path).where("key = 'a-7'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan millrace_cache" in plan and "Filter key" not in plan and "+- Filter" not in plan and " Filter (" not in plan


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    entries(spark, [("kept", b"x", 0)]).write.format("millrace_cache").option("path", str(tmp_path)).mode("append").save()
    bad = entries(spark, [(f"k{i}", b"v", i) for i in range(30)]).withColumn("value", F.when(F.col("extra") == 17, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("millrace_cache").option("path", str(tmp_path)).mode("append").save()
    assert [r.key for r in read(spark, tmp_path).collect()] == ["kept"]
    assert not [x for x in os.listdir(tmp_path) if x.startswith(".")]


def fetch(spark, log, tmp_path):
    query = (
        spark.readStream.format("millrace_key_log").option("path", str(log)).load().writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sorted((r.at_ms, r.key, r.full) for r in spark.read.schema("key string, at_ms long, full boolean").parquet(str(tmp_path / "out")).collect())


def test_key_log_goes_on_after_a_restart(spark, tmp_path):
    log = tmp_path / "log"
    cache_tree.log_keys(str(log), ["a", "b"], 10_000)
    cache_tree.log_keys(str(log), ["c"], 12_000)
    first = [(10_000, "a", True), (10_000, "b", True), (12_000, "c", True)]
    assert fetch(spark, log, tmp_path) == first
    cache_tree.log_keys(str(log), ["late"], 9_000)
    cache_tree.log_keys(str(log), ["d"], 14_000)
    second = sorted([*first, (9_000, "late", False), (14_000, "d", False)])
    assert fetch(spark, log, tmp_path) == second
    assert fetch(spark, log, tmp_path) == second
    cache_tree.log_keys(str(log), ["e"], 14_000 + 3_600_001)
    assert fetch(spark, log, tmp_path) == sorted([*second, (14_000 + 3_600_001, "e", True)])


def test_offsets_are_bounded_and_full_fetches_go_back_no_further_than_the_log(tmp_path):
    for t in range(0, 200_000, 1_000):
        cache_tree.log_keys(str(tmp_path), [str(t)], t)
    reader = cache_tree.LogReader(str(tmp_path), 5_000, 60_000)
    end = reader.latestOffset()
    assert end["since"] == 199_000 and len(end["seen"]) == 6
    times = lambda start: [int(p.name[:15]) for p in reader.partitions(start, end)]
    assert times(reader.initialOffset()) == list(range(139_000, 200_000, 1_000))
    assert times({"since": 190_000, "seen": []}) == list(range(185_000, 200_000, 1_000))
    assert times({"since": 100_000, "seen": []}) == list(range(139_000, 200_000, 1_000))
