"""Lease bookkeeping in batch form: reconciliation of reports with grants, sweeps and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import timeline


def unknown_tasks(reported: DataFrame, grants: DataFrame) -> DataFrame:
    """Reported (servant, grant_id) that the servant holds no live grant for: it is told to drop them."""
    return reported.join(grants.where("not zombie"), ["servant", "grant_id"], "left_anti")


def permitted_tasks(reported: DataFrame, grants: DataFrame) -> DataFrame:
    return reported.join(grants.where("not zombie"), ["servant", "grant_id"], "left_semi")


def orphans(grants: DataFrame, servants: DataFrame) -> DataFrame:
    """Grants whose servant has left."""
    return grants.join(servants, "servant", "left_anti")


def swept_zombies(grants: DataFrame, reported: DataFrame) -> DataFrame:
    """Zombie grants that a reporting servant no longer lists."""
    heard = reported.select("servant").distinct()
    return grants.where("zombie").join(heard, "servant", "left_semi").join(reported, ["servant", "grant_id"], "left_anti")


def lease_sessions(beats: DataFrame, lease: str) -> DataFrame:
    """Uptimes per servant: heartbeats at most ``lease`` apart belong together, and an uptime ends a lease after its last."""
    found = timeline.uptimes(beats, ["servant"], at="ts", gap=lease)
    return found.select("servant", "session", F.col("first").alias("discovered_at"), (F.col("last") + F.expr(f"interval {lease}")).alias("expires_at"), F.col("n").alias("beats"))


def latest_snapshot(beats: DataFrame, *columns: str) -> DataFrame:
    """The last heartbeat of each servant."""
    return beats.groupBy("servant").agg(F.max_by(F.struct("ts", *columns), F.struct("ts", "event_id")).alias("s")).select("servant", "s.*")


def visible_snapshot(refreshes: DataFrame, bound: str) -> DataFrame:
    """For each refresh (servant, ts, event_id, ok) the time of the snapshot that is served after it.

    A refresh that succeeds replaces the snapshot; one that fails keeps it, but clears it once it is older than ``bound``.
    """
    known = timeline.running_last(refreshes, ["servant"], at="ts", order="event_id", value=F.when(F.col("ok"), F.col("ts")), name="_last")
    return known.withColumn("snapshot_at", F.when(F.col("ts") - F.col("_last") <= F.expr(f"interval {bound}"), F.col("_last"))).drop("_last")


def expired(leases: DataFrame, now: str) -> DataFrame:
    """Leases whose end lies strictly before ``now``."""
    return leases.where(F.col("expires_at") < F.expr(f"timestamp_ntz'{now}'"))


def renew(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``renewed`` for each asked grant: false if it is unknown or a zombie."""
    live = grants.where("not zombie").select("grant_id").distinct().withColumn("live", F.lit(True))
    return requests.join(live, "grant_id", "left").withColumn("renewed", F.coalesce("live", F.lit(False))).drop("live")
