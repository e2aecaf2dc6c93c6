"""A cache's index as a table with versions: puts, gets and purges arrive as deltas over a base and are merged when it is read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DELTA = "key string, touched long, op string, size long, used long, puts long, purged boolean, version int"
_BASE = "key string, size long, last_used long, overwrites long"


def net(changes: DataFrame) -> DataFrame:
    """One row per key of changes (key, op put, get or purge, size, ts, seq): what they do together to the key's entry.

    ``touched`` is the last get before any write; ``op`` the last write, null without one; ``used`` the last put or get since
    it, ``puts`` those since the last purge, ``purged`` whether there is one.  Rows go by (ts, seq); null keys and unknown ops are left out."""
    known = changes.where("key is not null and op in ('put', 'get', 'purge')").withColumn("at", F.struct("ts", "seq"))
    write, get = F.col("op") != "get", F.col("op") == "get"
    ends = known.groupBy("key").agg(
        F.min(F.when(write, F.col("at"))).alias("first"), F.max(F.when(write, F.col("at"))).alias("last"), F.max(F.when(F.col("op") == "purge", F.col("at"))).alias("purge"),
        F.max_by(F.when(write, F.col("op")), F.when(write, F.col("at"))).alias("end"), F.max_by("size", F.when(write, F.col("at"))).alias("end_size"))
    every = known.join(ends, "key")
    got = every.groupBy("key").agg(
        F.max(F.when(get & (F.col("first").isNull() | (F.col("at") < F.col("first"))), F.col("ts"))).alias("touched"),
        F.first("end").alias("op"), F.first("end_size").alias("size"),
        F.max(F.when(F.col("at") >= F.col("last"), F.col("ts"))).alias("used"),
        F.count_if((F.col("op") == "put") & (F.col("purge").isNull() | (F.col("at") > F.col("purge")))).alias("puts"),
        F.first(F.col("purge").isNotNull()).alias("purged"))
    return got.select("key", "touched", "op", F.when(F.col("op") == "put", F.col("size")).alias("size"), F.when(F.col("op") == "put", F.col("used")).alias("used"), "puts", "purged")


def _merge(entry: Column, d: Column) -> Column:
    """An entry, or null, after one delta of its key."""
    kept = F.when(entry.isNotNull(), F.struct(entry["size"].alias("size"), F.greatest(entry["last_used"], d["touched"]).alias("last_used"), entry["overwrites"].alias("overwrites")))
    more = F.when(entry.isNull() | d["purged"], d["puts"] - 1).otherwise(entry["overwrites"] + d["puts"])
    put = F.struct(d["size"].alias("size"), d["used"].alias("last_used"), more.alias("overwrites"))
    return F.when(d["op"].isNull(), kept).when(d["op"] == "put", put)


class VersionedIndex:
    """The index below ``root``: ``delta/version=n`` for each applied version and ``base/version=n`` for compacted ones.

    A version is there once its folder is complete, so that a write that was lost can be made again; readers see the base that
    is nearest before the version they ask for and the deltas after it, whose number compaction keeps small."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [f.getPath() for f in files.listStatus(path)]
        done = [p for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(m[1]) for p in done if (m := re.fullmatch(r"version=(\d+)", p.getName())))

    def apply(self, changes: DataFrame) -> int:
        """Write the next version; the changes must be newer than those before."""
        version = max([0, *self._versions("delta"), *self._versions("base")]) + 1
        net(changes).write.mode("overwrite").parquet(f"{self.root}/delta/version={version}")
        return version

    def snapshot(self, version: int | None = None) -> DataFrame:
        """(key, size, last_used, overwrites) of all entries as of ``version``, the newest without one."""
        deltas = self._versions("delta")
        version = max(deltas, default=0) if version is None else version
        base = max((v for v in self._versions("base") if v <= version), default=0)
        used = [v for v in deltas if base < v <= version]
        if self._versions("base") or used:
            missing = set(range(base + 1, version + 1)) - set(used)
            if missing:
                raise ValueError(f"versions {sorted(missing)} are not there")
        start = self.spark.read.schema(_BASE).parquet(f"{self.root}/base/version={base}") if base else self.spark.createDataFrame([], _BASE)
        if not used:
            return start
        parts = [self.spark.read.schema(_DELTA).parquet(f"{self.root}/delta/version={v}").withColumn("version", F.lit(v)) for v in used]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        steps = every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("version", "touched", "op", "size", "used", "puts", "purged"))).alias("steps"))  # one a version
        entry = F.when(F.col("overwrites").isNotNull(), F.struct("size", "last_used", "overwrites"))
        got = start.join(steps, "key", "full").withColumn("entry", F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), entry, _merge))
        return got.where(F.col("entry").isNotNull()).select("key", "entry.*")

    def compact(self, version: int | None = None) -> int:
        """Write the base of ``version``; snapshots of earlier versions stay what they are."""
        version = max(self._versions("delta"), default=0) if version is None else version
        self.snapshot(version).write.mode("overwrite").parquet(f"{self.root}/base/version={version}")
        return version
