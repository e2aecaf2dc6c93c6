"""Matching of task requests to executor hosts: capacity, eligibility, normalisation and choice of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.streaming.run import shared_dir

#: Rows up to which tables made from the registry are sent to all executors.
BROADCAST_ROWS = 500_000
#: Longest lease and wait that are accepted, in milliseconds.
MAX_LEASE_MS, MAX_WAIT_MS = 30_000, 10_000


def capacity_available(running: str = "running_tasks", floor_gib: int = 10) -> Column:
    """Tasks a host can hold now: its own running ones if memory is short, else what processors and foreign load leave."""
    r = F.col(running)
    foreign = F.greatest(F.col("current_load") - r, F.lit(0))
    free = F.least(F.col("max_tasks"), F.greatest(F.col("num_processors") - foreign, F.lit(0)))
    low = (F.col("total_memory_gib") != 0) & (F.col("memory_available_gib") < floor_gib)
    return F.when(low, r).otherwise(free)


def host_of(location: Column) -> Column:
    """Host part of ``ip:port``."""
    return F.regexp_replace(location, ":[0-9]+$", "")


def normalize_heartbeats(beats: DataFrame, user_tokens: tuple[str, ...], servant_tokens: tuple[str, ...], min_version: int = 0) -> DataFrame:
    """Heartbeats with ``reject`` (null if accepted) and the registry values that they amount to."""
    user, servant = F.col("token").isin(*user_tokens), F.col("token").isin(*servant_tokens)
    parsed = F.col("reported_location").rlike(r"^[0-9.]+:[0-9]{1,5}$")
    reject = (
        F.when(~user & ~servant, "access_denied").when(F.col("version") < min_version, "version_too_old")
        .when(~parsed, "invalid_location").when(F.col("next_heartbeat_in_ms") > MAX_LEASE_MS, "invalid_lease")
    )
    nat = F.col("observed_location") != F.col("reported_location")
    reason = F.when(~servant, 100).when(nat, 4).otherwise(0)
    tasks = F.when(nat | ~servant | (F.col("next_heartbeat_in_ms") == 0), 0).otherwise(F.col("max_tasks")).cast("bigint")
    return beats.withColumns({
        "reject": reject, "not_accepting_reason": reason, "accepted_tasks": tasks,
        "num_processors": F.coalesce(F.nullif(F.col("num_processors"), F.lit(0)), F.col("max_tasks")),
        "priority": F.when(F.col("priority").isin(1, 2), F.col("priority")).otherwise(2),
    })


def eligible(servants: DataFrame, classes: DataFrame) -> DataFrame:
    """Hosts for each (env, min_version): the environment is an equi-join key, so nothing is compared crosswise."""
    hosts = servants.where("max_tasks <> 0").withColumn("env", F.explode(F.array_distinct("environments")))
    return classes.join(hosts, "env").where("version >= min_version")


def free(servants: DataFrame) -> DataFrame:
    """Hosts with room for one more task, with ``capacity_available``."""
    return servants.withColumn("capacity_available", capacity_available()).where("running_tasks < capacity_available")


def pick_servants(requests: DataFrame, servants: DataFrame) -> DataFrame:
    """One host per request against a snapshot: a half-idle dedicated host, else the least utilised, else one's own.

    What is best depends on the request only by (env, min_version) and by which host is its own, so hosts are ranked once
    per class, keeping the best of each machine; a request then takes the first of two that is not its own.
    """
    classes = requests.select("env", "min_version").distinct()
    ok = eligible(free(servants), classes).withColumn("ip", host_of(F.col("observed_location")))
    utilization = F.col("running_tasks") / F.col("capacity_available")
    tier = F.when((F.col("priority") == 1) & (F.col("running_tasks") * 2 < F.col("num_processors")), 0).otherwise(1)
    ok = ok.withColumns({"utilization": utilization, "tier": tier})
    order = F.struct("tier", "utilization", "registry_ord")
    best = ok.groupBy("env", "min_version", "ip").agg(F.min(order).alias("best"), F.min(F.struct("utilization", "registry_ord")).alias("own"))
    rank = F.row_number().over(W.partitionBy("env", "min_version").orderBy("best"))
    first = best.withColumn("rank", rank).where("rank <= 2").select("env", "min_version", F.col("ip").alias("at"), F.col("best.registry_ord").alias("pick"), "rank")
    first = first.groupBy("env", "min_version").agg(F.collect_list(F.struct("rank", "at", "pick")).alias("best"))  # two at most
    own = best.select("env", "min_version", F.col("ip").alias("requestor_ip"), F.col("own.registry_ord").alias("self"))
    # the registry bounds both tables; while they are small, no request is shuffled
    few = best.count() <= BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df
    got = requests.join(small(first), ["env", "min_version"], "left").join(small(own), ["env", "min_version", "requestor_ip"], "left")
    other = F.array_min(F.filter("best", lambda x: x["at"] != F.col("requestor_ip")))["pick"]
    return got.select("request_id", F.coalesce(other, "self").alias("registry_ord")).where("registry_ord is not null")


def cluster_rollup(servants: DataFrame) -> DataFrame:
    """One row over all hosts: how many, running tasks, capacity, unavailable and available."""
    c = servants.withColumn("c", capacity_available())
    s = c.agg(
        F.count("*").alias("servants_up"), F.sum("running_tasks").alias("running"), F.sum("max_tasks").alias("capacity"),
        F.sum(F.col("max_tasks") - F.col("c")).alias("capacity_unavailable"),
    )
    left = F.col("capacity") - F.col("running") - F.col("capacity_unavailable")
    return s.withColumn("capacity_available", F.greatest(left, F.lit(0)))


def numbered(rows: DataFrame, key: str, ranges: int = 64) -> DataFrame:
    """``rows`` with ``id``, consecutive numbers from 1 in order of a unique ``key``, without sorting all rows in one task.

    Rows are dealt out by ranges of the key; each range is numbered on its own and moved by the sizes of those before it.
    """
    shared_dir(rows.sparkSession)
    # written, as the bounds of the ranges come from a sample and must not differ between two readings
    parts = rows.repartitionByRange(ranges, key).withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))  # one row for each range
    ahead = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("part").orderBy(key))
    return parts.join(F.broadcast(sizes.select("part", ahead.alias("ahead"))), "part").withColumn("id", F.col("ahead") + place).drop("part", "ahead")


def batch_grants(batches: DataFrame) -> DataFrame:
    """One row for each slot that a batch (request_id, immediate, prefetch, free) asks for, immediate ones first.

    Slots are granted while hosts are ``free`` and a first one that is not ends its kind, so the next are not ``tried``. A slot
    may wait only if it is the first of all, or a prefetch while nothing has been granted.
    """
    slots = batches.withColumn("slot", F.explode(F.expr("sequence(1, immediate + prefetch)"))).where("slot <= immediate + prefetch")
    now = F.least("immediate", "free")  # granted at once
    prefetch, place = F.col("slot") > F.col("immediate"), F.when(F.col("slot") > F.col("immediate"), F.col("slot") - F.col("immediate") + now).otherwise(F.col("slot"))
    return slots.select(
        "request_id", "slot", prefetch.alias("is_prefetch"), (place <= F.col("free")).alias("granted"), (place <= F.col("free") + 1).alias("tried"),
        F.when(prefetch, (now == 0) & (place == 1)).otherwise(F.col("slot") == 1).alias("may_wait"),
    )
