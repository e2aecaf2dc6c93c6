"""Consistent hashing and on-disk placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.framing import ring_hash
from millrace.functions.text import PATH_MAX, percent_encode

#: Ring points per unit of weight, and the hash range.
POINTS, RANGE = 100, 1 << 32
#: Interval buckets of the hash range that probes and ring points are joined by.
BUCKETS = 4096


def ring(nodes: DataFrame) -> DataFrame:
    """(node, lo, hi] hash intervals of nodes (node, weight); the wrap-around interval is split in two."""
    points = nodes.select("node", F.explode(F.sequence(F.lit(0), (F.col("weight") * POINTS - 1).cast("int"))).alias("i"))
    points = points.select("node", ring_hash(F.concat("node", F.lit("#VN"), F.col("i").cast("string"))).alias("hi"))
    points = points.groupBy("hi").agg(F.min("node").alias("node"))  # equal points: the smaller name
    points = points.withColumn("_part", F.floor(F.col("hi") / (RANGE // BUCKETS)))
    # a part of the hash range takes its first bound from the last point of the parts before it; there are BUCKETS parts at most
    whole = W.partitionBy(F.lit(0))
    tops = points.groupBy("_part").agg(F.max("hi").alias("_top"))
    tops = tops.select("_part", F.lag("_top").over(whole.orderBy("_part")).alias("_before"), F.max("_top").over(whole).alias("last"))
    points = points.withColumn("_lo", F.lag("hi").over(W.partitionBy("_part").orderBy("hi"))).join(tops, "_part")
    points = points.select("node", "hi", F.coalesce("_lo", "_before").alias("lo"), "last")
    body = points.select("node", F.coalesce("lo", F.lit(-1)).alias("lo"), "hi")
    wrap = points.where("lo is null").select("node", F.col("last").alias("lo"), F.lit(RANGE).alias("hi"))
    return body.union(wrap.where("lo < hi"))


def places(intervals: DataFrame) -> DataFrame:
    """(node, hi, place): intervals numbered from 1 by (hi, node), each part of the hash range on its own."""
    dealt = intervals.select("node", "hi", F.floor(F.col("hi") / (RANGE // BUCKETS)).alias("_part"))
    ahead = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))  # a row for each part
    inside = F.row_number().over(W.partitionBy("_part").orderBy("hi", "node"))
    return dealt.withColumn("_in", inside).join(sizes, "_part").select("node", "hi", (F.col("_ahead") + F.col("_in")).cast("long").alias("place"))


def assign(keys: DataFrame, intervals: DataFrame, h: Column) -> DataFrame:
    """``keys`` with the node whose interval holds the hash ``h``: an equi-join on buckets of the hash range, then the bounds."""
    width = RANGE // BUCKETS
    spread = F.explode(F.sequence(F.floor((F.col("lo") + 1) / width), F.least(F.floor(F.col("hi") / width), F.lit(BUCKETS - 1)))).alias("_bucket")
    spans = intervals.select("node", "lo", "hi", spread)
    probes = keys.withColumn("_h", h).withColumn("_bucket", F.floor(F.col("_h") / width))
    return probes.join(spans, "_bucket").where("_h > lo and _h <= hi").drop("_bucket", "lo", "hi", "_h")


def entry_path(key: str = "key", node: str = "node", fan_out: int = 16) -> Column:
    """``shard/d0/d1/encoded key``; null if the encoded key is too long."""
    h = ring_hash(F.concat(F.lit("dir:"), F.col(key)))
    name = percent_encode(F.col(key))
    path = F.concat_ws("/", F.col(node), F.lower(F.hex(h % fan_out)), F.lower(F.hex(F.floor(h / fan_out) % fan_out)), name)
    return F.when(F.length(name) <= PATH_MAX, path)


def misplaced(found: DataFrame, action: str = "move") -> DataFrame:
    """Entries (path, expected) that lie elsewhere than expected, with what to do about them."""
    return found.where("not (path <=> expected)").withColumn("action", F.lit(action))


def startup_load(files: DataFrame, nodes: DataFrame, action: str = "move", fan_out: int = 16) -> DataFrame:
    """``files`` (path relative to the cache's root, ...) with ``key``, ``expected`` and what a starting cache does with each.

    A file that does not lie in a shard's two levels of sub-directories is ``stray`` and has no key; the others are
    ``load``ed if they lie where the ring puts their key, and else get ``action`` (move, delete or ignore).
    """
    parts = F.split("path", "/")
    marked = files.withColumn("_stray", F.size(parts) != 4)
    known = marked.where("not _stray").withColumn("key", F.try_url_decode(F.replace(F.get(parts, F.lit(3)), F.lit("+"), F.lit("%2B"))))
    known = known.withColumn("_stray", F.col("key").isNull())
    placed = assign(known.where("not _stray"), ring(nodes), ring_hash(F.col("key")))
    placed = placed.withColumn("expected", entry_path(fan_out=fan_out)).drop("node")
    placed = placed.withColumn("action", F.when(F.col("path") == F.col("expected"), "load").otherwise(action))
    blank = [F.lit(None).cast("string").alias(n) for n in ("key", "expected")]
    stray = marked.where("_stray").unionByName(known.where("_stray").drop("key")).select("*", *blank, F.lit("stray").alias("action"))
    return placed.unionByName(stray).drop("_stray")


def directories(shards: DataFrame, fan_out: int = 16) -> DataFrame:
    """The fixed tree of sub-directories of each shard."""
    digit = F.sequence(F.lit(0), F.lit(fan_out - 1))
    two = shards.select("node", F.explode(digit).alias("a")).select("node", "a", F.explode(digit).alias("b"))
    return two.select(F.concat_ws("/", "node", F.lower(F.hex("a")), F.lower(F.hex("b"))).alias("directory"))
