"""Result cache: lookups over two levels, eviction by age and size, counters and key logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def two_level_get(wanted: DataFrame, l1: DataFrame, l2: DataFrame) -> DataFrame:
    """``wanted`` keys with ``level`` (1, 2 or null for a miss), the size found, and whether it moves into level 1."""
    a = l1.select("key", F.col("size").alias("s1"))
    b = l2.select("key", F.col("size").alias("s2"))
    got = wanted.join(a, "key", "left").join(b, "key", "left")
    level = F.when(F.col("s1").isNotNull(), 1).when(F.col("s2").isNotNull(), 2)
    return got.withColumns({"level": level, "size": F.coalesce("s1", "s2"), "fill": F.col("s1").isNull() & F.col("s2").isNotNull()}).drop("s1", "s2")


def worth_asking(wanted: DataFrame, keys: DataFrame, fresh: str = "10 minutes") -> DataFrame:
    """``wanted`` (key, asked_at, filter_at, ...) with ``ask``: false if the key is unknown to a list of keys that is still fresh.

    ``filter_at`` is when the list was taken; one that is older than ``fresh``, or none at all (null), rules nothing out.
    A null key is in no list.
    """
    known = keys.select("key").distinct().withColumn("_known", F.lit(True))
    got = wanted.join(known, "key", "left")
    young = F.coalesce(F.col("filter_at") + F.expr(f"interval {fresh}") > F.col("asked_at"), F.lit(False))
    return got.withColumn("ask", ~young | F.col("_known").isNotNull()).drop("_known")


def touched(entries: DataFrame, gets: DataFrame) -> DataFrame:
    """``entries`` with ``last_used`` moved to their last get (key, ts seconds); a get never makes an entry older, and gets of
    unknown keys leave no trace."""
    last = gets.groupBy("key").agg(F.max("ts").alias("_got"))
    return entries.join(last, "key", "left").withColumn("last_used", F.greatest("last_used", "_got")).drop("_got")


def latest_entries(entries: DataFrame) -> DataFrame:
    """One row per key: the last write by (last_used, seq), and how often it was overwritten."""
    return entries.groupBy("key").agg(
        F.max_by("size", F.struct("last_used", "seq")).alias("size"), F.max("last_used").alias("last_used"), (F.count("*") - 1).alias("overwrites")
    )


def running_before(entries: DataFrame, newest_first: bool, width: int = 3600) -> DataFrame:
    """``entries`` with ``before``, the bytes of all entries that come earlier by ``last_used`` and key.

    Sums run in three levels: over periods of ``width`` seconds, whose number is bounded by the age of the oldest entry,
    over the seconds of a period, and over the entries of a second. So no task sorts the whole cache, nor a burst of more
    than a second.
    """
    sign = -1 if newest_first else 1
    past = lambda spec: F.coalesce(F.sum("_bytes").over(spec.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = entries.withColumns({"_s": F.col("last_used") * sign, "_bytes": F.col("size")})
    seconds = marked.groupBy("_s").agg(F.sum("_bytes").alias("_bytes")).withColumn("_p", F.floor(F.col("_s") / width))
    periods = seconds.groupBy("_p").agg(F.sum("_bytes").alias("_bytes")).select("_p", past(W.orderBy("_p")).alias("_far"))
    ahead = seconds.withColumn("_near", past(W.partitionBy("_p").orderBy("_s"))).join(periods, "_p").select("_s", (F.col("_far") + F.col("_near")).alias("_ahead"))
    inside = marked.withColumn("_inside", past(W.partitionBy("_s").orderBy("key")))
    return inside.join(ahead, "_s").withColumn("before", F.col("_ahead") + F.col("_inside")).drop("_s", "_bytes", "_ahead", "_inside")


def purge_oldest(entries: DataFrame, limit: int, keep: float = 0.95) -> DataFrame:
    """Entries to delete, oldest first, until less than ``keep * limit`` bytes are left."""
    total = entries.agg(F.sum("size").cast("double").alias("_total"))  # one row
    return running_before(entries, False).join(F.broadcast(total)).where(F.col("_total") - F.col("before") >= keep * limit).drop("_total")


def retain_newest(entries: DataFrame, capacity: int) -> DataFrame:
    """Entries with ``keep``: newest first until ``capacity`` bytes are reached; the others await removal."""
    return running_before(entries, True).withColumn("keep", F.col("before") < capacity)


def new_keys(log: DataFrame, now: str, since_seconds: int, slack: int = 5) -> DataFrame:
    """Keys of the log (key, ts) that a reader must fetch: those newer than its last fetch and a little more."""
    return log.where(F.col("ts") >= F.expr(f"timestamp_ntz'{now}' - interval {since_seconds + slack} seconds"))
