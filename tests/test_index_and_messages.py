"""The versioned index against a dictionary, and messages both ways."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import messages
from millrace.operators import versions


def replay(rows):
    held = {}
    for key, op, size, ts, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[3], r[4])):
        if op == "put":
            held[key] = (size, ts, held[key][2] + 1 if key in held else 0)
        elif op == "get" and key in held:
            held[key] = (held[key][0], max(held[key][1], ts), held[key][2])
        elif op == "purge":
            held.pop(key, None)
    return held


def test_any_version(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.choice([None, *"abcdefgh"]), rng.choice(["put", "put", "get", "get", "purge", "other"]), rng.randrange(100), i // 3, i) for i in range(300)]
    index, cuts = versions.VersionedIndex(spark, str(tmp_path / "index")), [0, 40, 90, 91, 200, 300]
    assert index.snapshot().collect() == []
    for n, (i, j) in enumerate(zip(cuts, cuts[1:])):
        assert index.apply(spark.createDataFrame(rows[i:j], "key string, op string, size long, ts long, seq long")) == n + 1
        if n in (1, 3):
            assert index.compact() == n + 1
    for n, j in enumerate(cuts[1:]):
        assert {r.key: (r.size, r.last_used, r.overwrites) for r in index.snapshot(n + 1).collect()} == replay(rows[:j])
    assert index.apply(spark.createDataFrame([], "key string, op string, size long, ts long, seq long")) == 6
    assert {r.key for r in index.snapshot().collect()} == set(replay(rows))
    with pytest.raises(ValueError, match="not there"):
        index.snapshot(9)


INNER = T.StructType([T.StructField("position", T.LongType()), T.StructField("keep", T.BooleanType())])
SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("exit_code", T.IntegerType()), T.StructField("reason", T.IntegerType(), metadata={"enum": {"UNKNOWN": 0, "BUSY": 4}}),
    T.StructField("output", T.BinaryType()), T.StructField("name", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("files", T.ArrayType(T.StringType())),
    T.StructField("patches", T.MapType(T.StringType(), T.ArrayType(INNER))), T.StructField("sizes", T.MapType(T.LongType(), T.LongType())), T.StructField("inner", INNER),
])


def test_round_trip(spark):
    full = (2**60 + 1, -3, 4, b"\x00\xff", 'q"é', 0.5, ["a", None, ""], {".o": [(7, True), (None, None)]}, {9: 2**40}, (1, None))
    df = spark.createDataFrame([(full,), ((None,) * 10,), (None,)], T.StructType([T.StructField("m", SCHEMA)]))
    shown = df.select(messages.to_message(F.col("m"), SCHEMA).alias("j"))
    rows = [r.j for r in shown.collect()]
    assert json.loads(rows[0]) == {
        "id": "1152921504606846977", "exit_code": -3, "reason": 4, "output": "AP8=", "name": 'q"é', "share": 0.5, "files": ["a", "", ""],
        "patches": {".o": [{"position": "7", "keep": True}, {"position": "0", "keep": False}]}, "sizes": {"9": "1099511627776"}, "inner": {"position": "1", "keep": False},
    }
    assert json.loads(rows[1]) == {"id": "0", "exit_code": 0, "reason": 0, "output": "", "name": "", "share": 0.0, "files": [], "patches": {}, "sizes": {}}
    assert rows[2] is None
    back = shown.select(messages.from_message(F.col("j"), SCHEMA).alias("m")).collect()
    assert back[0].m.asDict(True) == {
        "id": 2**60 + 1, "exit_code": -3, "reason": 4, "output": b"\x00\xff", "name": 'q"é', "share": 0.5, "files": ["a", "", ""],
        "patches": {".o": [{"position": 7, "keep": True}, {"position": 0, "keep": False}]}, "sizes": {9: 2**40}, "inner": {"position": 1, "keep": False}}
    assert (back[1].m.id, back[1].m.files, back[1].m.inner) == (0, [], None) and back[2].m is None


def test_other_texts(spark):
    texts = ['{"id": 5, "exit_code": "6", "reason": "BUSY", "new": [1]}', '{"id": "x"}', "{", "[1]", "", "{}", '{"files": ["a", null]}', '{"inner": {"keep": "maybe"}}', '{"reason": "NONE"}', '{"sizes": {"a": 1}}']
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(messages.from_message(F.col("t"), SCHEMA).alias("m")).collect()]
    assert (got[0].id, got[0].exit_code, got[0].reason) == (5, 6, 4)
    assert got[5].id == 0 and [m is None for m in got] == [False, True, True, True, True, False, True, True, True, True]
