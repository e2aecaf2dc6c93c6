"""Golden values and scenarios."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import arguments, codecs, framing, text
from millrace.operators import cache, leases, placement, scheduling
from millrace.sources import listing


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first().v


@pytest.mark.parametrize(("s", "size"), [("123", 123), ("2K", 2048), ("3M", 3145728), ("1G", 1 << 30), ("3A", None), ("", None), ("99999999999G", None), ("9223372036854775807", (1 << 63) - 1), ("9223372036854775808", None)])
def test_parse_size(spark, s, size):
    assert one(spark, text.parse_size(F.col("s")), s=s) == size


def test_split_drops_empty_parts(spark):
    assert one(spark, text.split_parts(F.col("s"), "/"), s="/a/b/c/d/e/f///g") == list("abcdefg")
    assert one(spark, text.split_tokens(F.col("s")), s="token1,token2,") == ["token1", "token2", ""]


def test_shell_escape(spark):
    assert one(spark, text.shell_escape(F.col("s")), s='"a b c"') == '\\"a\\ b\\ c\\"'
    assert one(spark, text.shell_escape(F.col("s")), s="it's\n") == "it's\\n"


def test_chunks(spark):
    got = one(spark, framing.encode_chunks(F.col("a")), a=["something", "fancy"])
    assert got == "9,5\r\nsomethingfancy"
    decode = framing.decode_chunks(F.col("b"))
    assert one(spark, decode, b=bytearray(got.encode())) == [b"something", b"fancy"]
    assert one(spark, decode, b=bytearray()) == []
    for bad in (b"5,2", b"5,5\r\nshort", b"a,b\r\nxx", b"9,5\r\nsomethingfancy!", b"999999999,999999999,999999999\r\nx"):
        assert one(spark, decode, b=bytearray(bad)) is None


def test_arguments(spark):
    parsed = arguments.parse(F.col("a"))
    argv = ["-c", "-std=c++11", "-I", "inc", "-o", "1.o", "1.cc"]
    p = one(spark, parsed, a=argv)
    assert [(o.opt, o.args) for o in p.options] == [("-c", []), ("-std=c++11", []), ("-I", ["inc"]), ("-o", ["1.o"])]
    assert p.files == ["1.cc"]
    assert one(spark, arguments.output_path(parsed), a=["-c", "dir/x.cc"]) == "x.o"
    assert one(spark, arguments.rewrite(parsed, ("-o",), ("-I",), ("-x", "c++"), False), a=argv) == ["-c", "-std=c++11", "-x", "c++"]
    assert one(spark, arguments.distributable(parsed), a=argv) is True
    assert one(spark, arguments.distributable(parsed), a=["-c", "a.cc", "b.cc"]) is False


def test_patch_moves_suffix_and_fills(spark):
    data = bytearray(b"xx/long/prefix/tail\0yy")
    at = F.expr("array(named_struct('position', 2, 'total_size', 17, 'suffix_to_keep', 5))")
    assert one(spark, framing.apply_patch(F.col("d"), at, F.lit("/w")), d=data) == b"xx/w/tail" + b"\0" * 10 + b"\0yy"
    assert one(spark, framing.apply_patch(F.col("d"), at, F.lit("/" * 18)), d=data) is None


def test_entry_codec_detects_damage():
    blob = codecs.encode_entry(0, b"out", b"err", b"f" * 123456)
    assert codecs.decode_entry(blob)["files"] == b"f" * 123456
    for bad in (blob[:-1], blob[1:], b"", blob[:-1] + b"x"):
        assert codecs.decode_entry(bad) is None
    assert codecs.path_locations(b"ab/p/x\0/p/yy\0/p/open", b"/p/") == [
        {"position": 2, "total_size": 4, "suffix_to_keep": 1}, {"position": 7, "total_size": 5, "suffix_to_keep": 2}]


def hosts(spark, rows):
    return spark.createDataFrame(
        [(i, f"10.0.0.{i}:1", e, m, load, n, p, 8, 64, 50, r) for i, e, m, load, n, p, r in rows],
        "registry_ord long, observed_location string, environments array<string>, max_tasks long, current_load long, num_processors long, "
        "priority int, version long, total_memory_gib long, memory_available_gib long, running_tasks long",
    )


def test_dedicated_host_is_preferred(spark):
    up = hosts(spark, [(1, ["e"], 8, 0, 16, 2, 0), (2, ["e"], 8, 2, 16, 1, 2)])
    asked = spark.createDataFrame([(1, "e", "1.1.1.1", 8), (2, "e", "10.0.0.2", 8)], "request_id long, env string, requestor_ip string, min_version long")
    assert {r.request_id: r.registry_ord for r in scheduling.pick_servants(asked, up).collect()} == {1: 2, 2: 1}


def test_unknown_tasks(spark):
    grants = spark.createDataFrame([(1, 100, False), (1, 101, True)], "servant long, grant_id long, zombie boolean")
    told = spark.createDataFrame([(1, 100), (1, 101), (1, 1000002)], "servant long, grant_id long")
    assert sorted(r.grant_id for r in leases.unknown_tasks(told, grants).collect()) == [101, 1000002]
    assert leases.swept_zombies(grants, told.where("grant_id <> 101")).first().grant_id == 101


def test_ring_is_even_and_stable(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    nodes = [(f"n{i}", i) for i in range(1, 6)]
    place = lambda ns: placement.assign(keys, placement.ring(spark.createDataFrame(ns, "node string, weight int")), F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("bigint"))
    before = {r.key: r.node for r in place(nodes).collect()}
    assert len(before) == 20_000
    for name, weight in nodes:
        assert abs(sum(v == name for v in before.values()) / 20_000 - weight / 15) < 0.05
    after = {r.key: r.node for r in place([*nodes, ("n6", 1)]).collect()}
    assert all(after[k] in (v, "n6") for k, v in before.items())


def test_cache_dirs_without_a_comma(spark):
    got = one(spark, text.parse_cache_dirs(F.col("s")), s="2K,/a,b::justpath")
    assert [(x.size, x.path) for x in got] == [(2048, "/a,b"), (None, None)]


def test_long_linemarker_is_kept_whole(spark):
    line = '# 1 "/opt/gcc/' + "x" * 2_000_000 + '" 2'
    assert one(spark, text.neutral_linemarkers(F.col("s"), F.lit("/opt/gcc"), "/r"), s=line) == line.replace("/opt/gcc", "/r")


def test_checksum_is_verified_and_cut(spark):
    data = one(spark, framing.add_checksum(F.col("b")), b=bytearray(b"body"))
    assert one(spark, framing.checked_body(F.col("b")), b=data) == b"body"
    for bad in (data[:-1], data + b"!", data[:63], b"", b"0" + data[1:]):
        if bad != data:
            assert one(spark, framing.checked_body(F.col("b")), b=bytearray(bad)) is None
    assert one(spark, framing.checked_body(framing.add_checksum(F.col("b"))), b=bytearray()) == b""


def test_cacheable_needs_all_macros_of_the_time(spark):
    every = [f"-D{m}=1" for m in ("__TIME__", "__DATE__", "__TIMESTAMP__")]
    for argv, source, want in ((["-c"], "int x;", True), (["-c"], "a __DATE__ b", False), (every, "a __DATE__ b", True), (every[:2], "__TIMESTAMP__", False)):
        assert one(spark, arguments.cacheable(F.col("a"), F.lit(source)), a=argv) is want


def test_numbers_are_consecutive(spark):
    got = scheduling.numbered(spark.range(0, 5000, 7).withColumnRenamed("id", "key"), "key")
    assert [r.id for r in got.orderBy("key").collect()] == list(range(1, len(range(0, 5000, 7)) + 1))


def test_cache_tree_on_disk(spark, tmp_path):
    nodes = spark.createDataFrame([("s1", 1), ("s2", 2)], "node string, weight int")
    keys = spark.createDataFrame([(f"key {i}/+%",) for i in range(12)], "key string")
    home = placement.assign(keys, placement.ring(nodes), framing.ring_hash(F.col("key"))).select("key", placement.entry_path().alias("path")).collect()
    root, want = tmp_path / "cache dir", {}
    for i, r in enumerate(home):
        path, action = (r.path, "load") if i > 2 else (f"s9/0/0/{r.path.split('/')[-1]}", "delete") if i else (f"{r.path}/deep", "stray")
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(codecs.encode_entry(i, b"out", b"", b"f" * i)[: -1 if i == 5 else None])
        want[path] = (None if action == "stray" else r.key, action, i)
    found = listing.entries(spark, str(root)).collect()
    assert {r.path: r.exit_code for r in found} == {p: None if i == 5 else i for p, (_, _, i) in want.items()}
    files = listing.tree(spark, str(root)).select(listing.relative(F.col("path"), str(root)).alias("path"), "size")
    assert {r.path: (r.key, r.action) for r in placement.startup_load(files, nodes, "delete").collect()} == {p: w[:2] for p, w in want.items()}
    assert {r.path for r in listing.stray(files.withColumn("path", F.concat(F.lit("/x/"), "path")), "/x").collect()} == {"/x/" + p for p, w in want.items() if w[1] == "stray"}
    (root / "top").write_bytes(b"1")
    assert [(r.name, r.size) for r in listing.children(spark, str(root)).collect()] == [("top", 1)]


def test_running_sums_of_a_burst(spark):
    rows = [(f"k{i:03}", 1 + i % 5, 7200 + i % 3 if i < 150 else i * 60) for i in range(300)]
    entries = spark.createDataFrame(rows, "key string, size long, last_used long")
    for newest in (False, True):
        got = {r.key: r.before for r in cache.running_before(entries, newest).collect()}
        total = 0
        for key, size, _ in sorted(rows, key=lambda r: (-r[2] if newest else r[2], r[0])):
            assert got[key] == total
            total += size


def test_gets_touch_entries(spark):
    entries = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "key string, last_used long")
    gets = spark.createDataFrame([("a", 9), ("a", 7), ("b", 3), ("x", 8)], "key string, ts long")
    assert {r.key: r.last_used for r in cache.touched(entries, gets).collect()} == {"a": 9, "b": 5, "c": 5}


def test_ring_in_parts(spark, monkeypatch):
    """Bounds and places as of one sorted list, whatever the parts."""
    nodes = [("a", 1), ("b", 3), ("c", 2)]
    df = spark.createDataFrame(nodes, "node string, weight int")
    for parts in (1, 8, 4096):
        monkeypatch.setattr(placement, "BUCKETS", parts)
        got = sorted((r.hi, r.node, r.lo) for r in placement.ring(df).collect())
        points = {}
        for n, w in nodes:
            for i in range(100 * w):
                h = int(hashlib.md5(f"{n}#VN{i}".encode()).hexdigest()[:8], 16)
                points[h] = min(points.get(h, n), n)
        order = sorted(points)
        want = [(h, points[h], lo) for lo, h in zip([-1, *order], order)] + [(1 << 32, points[order[0]], order[-1])]
        assert got == want
        assert [(r.hi, r.node) for r in placement.places(placement.ring(df)).orderBy("place").collect()] == [w[:2] for w in want]
    assert placement.ring(df.limit(0)).count() == 0


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_listing_has_folders_as_well_as_files(spark, tmp_path, scheme):
    """A table that is a folder of parts is one entry, of the size of its parts."""
    root = tmp_path / "t+(1) $.x"
    for name, size in (("a.parquet", 3), ("b.parquet/part-0.parquet", 4), ("b.parquet/deep/part-1.parquet", 5), ("c.txt", 1)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    found = listing.enumerated(spark, f"{scheme}{root}/").select("name", "is_folder", "size").collect()
    assert sorted(map(tuple, found)) == [("a.parquet", False, 3), ("b.parquet", True, 9), ("c.txt", False, 1)]
    from __spark_entry__ import queries

    got = queries()["s1_listing"](spark, f"{scheme}{root}").collect()
    assert sorted(map(tuple, got)) == [("a.parquet", True), ("b.parquet", True)]
