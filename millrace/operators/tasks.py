"""Submitted tasks: outcome of the lookup chain, routing of results and dumps by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(tasks: DataFrame, cached: DataFrame, running: DataFrame) -> DataFrame:
    """``outcome`` of each task: hit_cache, else reuse_existing, else actually_run; only cache control 1 reads the cache."""
    hit = cached.select(F.col("key").alias("cache_key")).distinct().withColumn("hit", F.lit(True))
    busy = running.groupBy("digest").agg(F.max("grant_id").alias("reused_grant"))
    got = tasks.join(hit, "cache_key", "left").join(busy, "digest", "left")
    found = (F.col("cache_control") == 1) & F.col("hit").isNotNull()
    outcome = F.when(found, "hit_cache").when(F.col("reused_grant").isNotNull(), "reuse_existing").otherwise("actually_run")
    return got.withColumn("outcome", outcome).withColumn("reused_grant", F.when(outcome == "reuse_existing", F.col("reused_grant"))).drop("hit")


def routing(exit_code: Column, quota_seconds: Column, attempts: Column) -> Column:
    """What follows a result: accept, rerun locally, or try the cloud again up to five times."""
    infra = (exit_code < 0) | (exit_code == 127)
    return F.when(infra & (quota_seconds <= 10), "local").when(infra & (attempts < 5), "retry").when(infra, "local").when(exit_code != 0, "local_rerun").otherwise("accept")


def first_waiter(waits: DataFrame) -> DataFrame:
    """The wait that takes each task's result: the first one; later ones find nothing."""
    return waits.groupBy("task_id").agg(F.min(F.struct("ts", "wait_id")).alias("w")).select("task_id", "w.wait_id")


def dump_by_state(tasks: DataFrame) -> DataFrame:
    """Tasks per state with the fields that the state shows: the exit code only when done."""
    shown = F.when(F.col("state") == "Done", F.col("exit_code"))
    return tasks.withColumn("shown", shown).groupBy("state").agg(
        F.count("*").alias("n"), F.count("shown").alias("n_exit"), F.coalesce(F.sum("shown"), F.lit(0)).alias("sum_exit"), F.min("task_id").alias("first_task"), F.max("started_at").alias("last_started")
    )


#: Sections of a dump and how far a task in each has come.
SECTIONS = {"Pending": ("pending_tasks", "PENDING"), "ReadyToFire": ("ready_tasks", "READY TO FIRE"), "Dispatched": ("dispatched_tasks", "DISPATCHED"), "Done": ("completed_tasks", "DONE")}
#: Fields that are known once a task has come so far.
KNOWN = {"start_deadline": 0, "ready_at": 1, "servant_location": 1, "dispatched_at": 2, "last_keep_alive_at": 2, "servant_task_id": 2, "completed_at": 3, "exit_code": 3, "stdout_size": 3, "stderr_size": 3}


def dump(tasks: DataFrame) -> DataFrame:
    """One row per task with its section and state's name; fields that its state does not know yet are null."""
    state, names = F.col("state"), list(SECTIONS)
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for n, v in zip(names, values) for x in (n, v)]), state)
    reached = pick(range(len(names)))
    shown = [F.when(reached >= KNOWN[c], F.col(c)).alias(c) if c in KNOWN else F.col(c) for c in tasks.columns if c != "state"]
    return tasks.select(pick([v[0] for v in SECTIONS.values()]).alias("section"), pick([v[1] for v in SECTIONS.values()]).alias("state"), *shown)


def quota_dump(claims: DataFrame, max_tasks: Column, overprovisioning: int) -> DataFrame:
    """Per machine the heavy and light waiters, the processes that hold a permission, and the limits.

    ``claims`` are (servant, pid, state waiting or granted, heavy). The list of holders is bounded by the machine's limits.
    """
    waits, holds = F.col("state") == "waiting", F.col("state") == "granted"
    got = claims.groupBy("servant").agg(
        F.count_if(waits & F.col("heavy")).alias("heavyweight_waiters"), F.count_if(waits & ~F.col("heavy")).alias("lightweight_waiters"), F.sort_array(F.collect_set(F.when(holds, F.col("pid")))).alias("pids")
    )
    return got.select(
        "servant", "heavyweight_waiters", "lightweight_waiters", F.size("pids").cast("bigint").alias("running_tasks"), max_tasks.alias("max_tasks"), F.lit(overprovisioning).alias("lightweight_task_overprovisioning"), "pids"
    )


def with_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Output ``files`` (task_id, suffix, ...) with their ``position``s to patch, 0 if there are none, and ``error``.

    A patch whose file is missing is an error of its task: it comes as a row without a file.
    """
    known = files.withColumn("_file", F.lit(True)).join(patches, ["task_id", "suffix"], "full")
    lost = F.when(F.col("_file").isNull(), F.lit("patch without a file"))
    return known.withColumns({"position": F.coalesce("position", F.lit(0)), "error": lost}).drop("_file")


def completion(exit_code: Column, stdout: Column, stderr: Column, error: Column) -> Column:
    """struct(exit_code, stdout, stderr): a failed post-processing replaces the result."""
    bad = error.isNotNull()
    return F.struct(F.when(bad, -1).otherwise(exit_code).alias("exit_code"), F.when(bad, "").otherwise(stdout).alias("stdout"), F.when(bad, error).otherwise(stderr).alias("stderr"))
