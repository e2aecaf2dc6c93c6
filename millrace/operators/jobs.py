"""Jobs that machines execute: the files they leave, what goes out with their results, what a machine shows of them, and what it
takes back from processes that are gone.

Files stay rows of their job; only names and places to patch are gathered, and a job has as many of them as files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.functions.machines import is_alive
from millrace.sources.listing import relative

_PLACES = "array<struct<position:bigint,total_size:bigint,suffix_to_keep:bigint>>"


def collected(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, ...) below ``root`` as (job, name, ...): the first folder is the job, the rest is the file's name.

    Files elsewhere, in ``root`` itself or without a path belong to no job and are left out.
    """
    part = F.split(relative(F.col("path"), root), "/", 2)
    found = files.where(F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/"))).withColumn("_part", part).where(F.size("_part") == 2)
    return found.select(F.col("_part")[0].alias("job"), F.col("_part")[1].alias("name"), *[F.col(c) for c in files.columns if c != "path"])


def manifest(files: DataFrame) -> DataFrame:
    """(job, files, bytes, names) of the ``files`` (job, name, content) that jobs left; names are sorted, and each counts once."""
    each = files.groupBy("job", "name").agg(F.max(F.octet_length("content")).alias("bytes"))
    return each.groupBy("job").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list("name")).alias("names"))


def out_of_band(files: DataFrame, results: DataFrame, prefix: str, workspace: Column) -> DataFrame:
    """(job, suffix, content, places, error) of the files that go out with a result (job, exit_code).

    Only jobs that ended with zero send files.  A name is ``prefix`` and the file's suffix; ``places`` are those of
    ``workspace``, ``prefix`` and the rest of a path in the content, which the receiver has to patch.  A file of another name
    has neither and an ``error``.  Null contents have no places.
    """
    sent = files.join(results.where("exit_code = 0").select("job"), "job", "left_semi")
    known = F.col("name").startswith(prefix)
    places = codecs.locations_of(F.col("content"), F.concat(workspace, F.lit("/" + prefix)))
    return sent.select(
        "job", F.when(known, F.substr("name", F.lit(len(prefix) + 1))).alias("suffix"), "content", F.when(known, places).alias("places"),
        F.when(~known, F.concat(F.lit("unexpected file "), "name")).alias("error"),
    )


def packed(sent: DataFrame) -> DataFrame:
    """(job, extra): the places to patch by suffix as one JSON message for each job."""
    sound = sent.where("error is null").select("job", F.struct("suffix", F.coalesce("places", F.array().cast(_PLACES)).alias("places")).alias("e"))
    return sound.groupBy("job").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list("e")))).alias("extra"))


def rebuilt(results: DataFrame, files: DataFrame) -> DataFrame:
    """(job, exit_code, error, suffix, patches) of what a submitter makes of ``results`` (job, exit_code, extra) and ``files`` (job, suffix).

    A negative code means that the call itself failed: there are no files, whatever came.  With zero the message must be readable,
    else the result is an error without files.  Other codes need no message, and their files nothing to patch.
    Jobs without files have one row without a suffix; a suffix that the message does not name has no patches.
    """
    told = F.from_json("extra", f"map<string,{_PLACES}>")
    bad = (F.col("exit_code") == 0) & told.isNull()
    heads = results.select("job", "exit_code", F.when(bad, "malformed message").alias("error"), F.when(F.col("exit_code") == 0, told).alias("told"))
    named = files.select("job", "suffix").withColumn("takes", F.lit(True))
    takes = (F.col("exit_code") >= 0) & F.col("error").isNull()
    got = heads.withColumn("takes", F.when(takes, F.lit(True))).join(named, ["job", "takes"], "left")
    patches = F.when(F.col("suffix").isNotNull(), F.coalesce(F.try_element_at("told", F.col("suffix")), F.array().cast(_PLACES)))
    return got.select("job", "exit_code", "error", "suffix", patches.alias("patches"))


def running_tasks(reports: DataFrame, now: Column, lease: str) -> DataFrame:
    """(servant, grant_id, digest) of all tasks in the last report of each machine, if its lease has not run out by ``now``.

    ``reports`` are (servant, ts, event_id, running array<struct<grant_id, digest>>); those after ``now`` do not count yet.
    A machine whose last report is null or empty runs nothing, whatever it ran before.
    """
    heard = reports.where(F.col("ts") <= now)
    last = heard.groupBy("servant").agg(F.max_by(F.struct("ts", "running"), F.struct("ts", "event_id")).alias("last"))
    last = last.where(F.col("last.ts") + F.expr(f"interval {lease}") > now)
    return last.select("servant", F.explode("last.running").alias("task")).select("servant", "task.grant_id", "task.digest")


def alive_tasks(runs: DataFrame, now: Column, keep: str) -> DataFrame:
    """Tasks that machines still know at ``now``, as RUNNING or DONE; what only a finished task has is null while it runs.

    ``runs`` are (servant, task_id, started_at, completed_at, exit_code, ...); a null ``completed_at`` has not ended yet, and a
    finished task is forgotten ``keep`` after its end.
    """
    done = F.coalesce(F.col("completed_at") <= now, F.lit(False))
    known = runs.where((F.col("started_at") <= now) & (~done | (F.col("completed_at") + F.expr(f"interval {keep}") > now)))
    shown = [F.when(done, F.col(c)).alias(c) for c in ("completed_at", "exit_code")]
    rest = [F.col(c) for c in runs.columns if c not in ("completed_at", "exit_code")]
    return known.select(*rest, F.when(done, "DONE").otherwise("RUNNING").alias("state"), *shown)


def engine_dump(machines: DataFrame, runs: DataFrame, now: Column, keep: str) -> DataFrame:
    """(servant, max_tasks, running_tasks, alive_tasks, tasks_run_ever) of each machine (servant, max_tasks) at ``now``.

    Machines without tasks show zeros; tasks of machines that are not listed are shown with a null limit.
    """
    begun = runs.where(F.col("started_at") <= now)
    running = F.coalesce(F.col("completed_at") > now, F.lit(True))
    alive = running | (F.col("completed_at") + F.expr(f"interval {keep}") > now)
    counts = begun.groupBy("servant").agg(
        F.count_if(running).alias("running_tasks"), F.count_if(alive).alias("alive_tasks"), F.count("*").alias("tasks_run_ever")
    )
    return machines.join(counts, "servant", "full").select(
        "servant", "max_tasks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("running_tasks", "alive_tasks", "tasks_run_ever")]
    )


def reclaimed(holders: DataFrame, processes: DataFrame) -> DataFrame:
    """(servant, pid, reclaimed_at, state) of the ``holders`` (servant, pid, since) whose process has ended.

    ``processes`` are states seen (servant, pid, ts, state letter); the last one counts, a process never seen is gone with a
    null state.  Holders are looked through at each full second, the first one at or after both the permission and the end.
    """
    last = processes.groupBy("servant", "pid").agg(F.max_by(F.struct("ts", "state"), F.struct("ts", "state")).alias("seen"))
    got = holders.join(last, ["servant", "pid"], "left").where(~F.coalesce(is_alive(F.col("seen.state")), F.lit(False)))
    at = F.greatest("since", F.col("seen.ts"))
    part = F.extract(F.lit("second"), at) - F.floor(F.extract(F.lit("second"), at))
    wait = F.make_dt_interval(secs=F.when(part > 0, 1 - part).otherwise(0))
    return got.select("servant", "pid", (at + wait).alias("reclaimed_at"), F.col("seen.state").alias("state"))
