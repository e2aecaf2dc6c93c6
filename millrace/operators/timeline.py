"""What holds at a moment: snapshots visible then, tasks held then, and which of two queues' entries meet.

Moments of a key are dealt over buckets of time.  A bucket passes its sum or its last value on to those after it, over two
levels, so a key with a third of all rows is many small tasks; rows of the same moment are added up before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.streaming.run import shared_dir

#: Seconds of a bucket, and buckets that pass their value on in one task.
BUCKET, FAN = 86_400, 1024
#: Entries of a queue that are folded in one array.
RUN = 512


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _before(summary: DataFrame, keys: list[str], at: str, fold, combine) -> DataFrame:
    """(keys, at, carried): the fold of ``own`` over all earlier rows of the key, one row per key and ``at``."""
    far = F.floor(F.col(at) / FAN)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    near = summary.withColumn("_far", far).withColumn("_near", fold("own").over(upto(W.partitionBy(*keys, "_far").orderBy(at))))
    tops = near.groupBy(*keys, "_far").agg(fold("own", at).alias("own"))
    tops = tops.select(*keys, "_far", fold("own").over(upto(W.partitionBy(*keys).orderBy("_far"))).alias("_top"))
    return near.join(tops, [*keys, "_far"]).select(*keys, at, combine("_top", "_near").alias("carried"))


def _carry(moments: DataFrame, keys: list[str], bucket: int, fold, combine, *, own: bool = True) -> DataFrame:
    """``moments`` (keys, at in microseconds, own), one row per key and moment, with ``upto``: the fold of ``own`` up to it, and
    with it if ``own``."""
    dealt = moments.withColumn("_bucket", F.floor(F.col("at") / F.lit(bucket * 1_000_000)))
    frame = W.partitionBy(*keys, "_bucket").orderBy("at").rowsBetween(W.unboundedPreceding, 0 if own else -1)
    inside = dealt.withColumn("_in", fold("own").over(frame))
    summary = dealt.groupBy(*keys, "_bucket").agg(fold("own", "at").alias("own"))
    ahead = _before(summary, keys, "_bucket", fold, combine)
    return inside.join(ahead, [*keys, "_bucket"]).select(*keys, "at", combine("carried", "_in").alias("upto"))


def _sum(c: str, by: str | None = None) -> Column:
    return F.sum(c)


def _last(c: str, by: str | None = None) -> Column:
    """The last value that is not null: in window order, or as an aggregate by the column ``by``."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(by))) if by else F.last(c, True)


def _add(a: str, b: str) -> Column:
    return F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))


def counts_upto(events: DataFrame, asked: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """(keys, at, upto) for the moments of ``asked`` (keys, at): sum of ``own`` of all ``events`` (keys, at, own) up to and with each."""
    every = events.select(*keys, "at", "own").union(asked.select(*keys, "at", F.lit(0).cast("long")))
    return _carry(every.groupBy(*keys, "at").agg(F.sum("own").alias("own")), keys, bucket, _sum, _add)


def held_at(requests: DataFrame, tasks: DataFrame, keys: list[str], *, at: str, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """``requests`` with ``held``: how many ``tasks`` of their key run at that time, ``start <= at < end``.

    Every task counts +1 where it starts and -1 where it ends, and requests read the running sum.  A null end runs for ever, a
    null start or an end not after it never runs; requests with a null key or time hold null, those without tasks 0."""
    runs = tasks.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    begins = runs.select(*keys, _micros(start).alias("at"), F.lit(1).cast("long").alias("own"))
    ends = runs.where(F.col(end).isNotNull()).select(*keys, _micros(end), F.lit(-1).cast("long"))
    moments = requests.where(F.col(at).isNotNull()).select(*keys, _micros(at).alias("at")).distinct()
    held = counts_upto(begins.union(ends), moments, keys, bucket).select(*keys, F.col("at").alias("_at"), F.col("upto").alias("held"))
    return requests.withColumn("_at", _micros(at)).join(held, [*keys, "_at"], "left").drop("_at")


def admitted(requests: DataFrame, limits: DataFrame, keys: list[str], *, floor: int = 2) -> DataFrame:
    """``requests`` that know what is ``held``, with ``admitted``: one more task within ``max_tasks``, and memory of at least
    ``floor``; a machine that ``limits`` does not know admits nothing."""
    own = limits.select(*keys, "max_tasks", "memory_available_gib")
    may = (F.col("held") + 1 <= F.col("max_tasks")) & (F.col("memory_available_gib") >= floor)
    return requests.join(own, keys, "left").withColumn("admitted", F.coalesce(may, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], *, at: str, order: str, fresh: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """``left`` with ``seen``, the row of ``right`` with the same key that is the last one at the time of the left row.

    ``right`` has ``at`` too; of several at one moment the one with the largest ``order`` counts.  A row older than the
    interval ``fresh`` is stale and not seen.  Left rows stay as they are: with a null key or time they see nothing, nor do
    those before the first row."""
    shot = F.struct(_micros(at).alias("_taken"), *[F.col(c) for c in right.columns if c not in keys])
    shots = right.where(F.col(at).isNotNull()).groupBy(*keys, _micros(at).alias("at")).agg(F.max_by(shot, F.col(order)).alias("own"))
    asked = left.where(F.col(at).isNotNull()).select(*keys, _micros(at).alias("at")).distinct()
    every = shots.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "at").agg(F.first("own", True).alias("own"))
    seen = _carry(every, keys, bucket, _last, _latest).select(*keys, F.col("at").alias("_at"), F.col("upto").alias("seen"))
    got = left.withColumn("_at", _micros(at)).join(seen, [*keys, "_at"], "left")
    if fresh:
        old = F.col("seen._taken") < _micros(at) - (F.unix_micros(F.expr(f"timestamp_seconds(0) + interval {fresh}")))
        got = got.withColumn("seen", F.when(~old, F.col("seen")))
    return got.withColumn("seen", F.col("seen").dropFields("_taken")).drop("_at")


def _latest(a: str, b: str) -> Column:
    return F.coalesce(F.col(b), F.col(a))


def _running(rows: DataFrame, keys: list[str], at: str, order: str, value: Column, name: str, bucket: int, fold, combine) -> DataFrame:
    each = rows.withColumn("_at", _micros(at)).withColumn("_own", value)
    moments = each.where(F.col("_at").isNotNull()).groupBy(*keys, F.col("_at").alias("at")).agg(fold("_own", order).alias("own"))
    ahead = _carry(moments, keys, bucket, fold, combine, own=False).select(*keys, F.col("at").alias("_at"), F.col("upto").alias("_ahead"), F.lit(True).alias("_known"))
    each = each.withColumn("_here", fold("_own").over(W.partitionBy(*keys, "_at").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    return each.join(ahead, [*keys, "_at"], "left").withColumn(name, F.when(F.col("_known"), combine("_ahead", "_here"))).drop("_at", "_own", "_here", "_ahead", "_known")


def running_sum(rows: DataFrame, keys: list[str], *, at: str, order: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of their key up to and with them, by (at, order); nulls add nothing.
    Rows with a null key or time have null."""
    return _running(rows, keys, at, order, F.coalesce(value.cast("long"), F.lit(0)), name, bucket, _sum, _add)


def running_last(rows: DataFrame, keys: list[str], *, at: str, order: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with the last ``value`` that is not null of their key up to and with them, by (at, order), null if there is none.
    Rows with a null key or time have null."""
    return _running(rows, keys, at, order, value, name, bucket, _last, _latest)


def numbered(rows: DataFrame, keys: list[str], *, at: str, order: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with their place from 1 among the rows of their key by (at, order); rows with a null key or time are left out."""
    return _numbered(rows.where(F.col(at).isNotNull()).dropna(subset=keys), keys, at, order, name, bucket).drop("_at")


def earlier(rows: DataFrame, keys: list[str], *, at: str, order: str, value: str, name: str, back: int, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with the ``value`` of the row that is ``back`` places before them in their key, null if there is none."""
    placed = numbered(rows, keys, at=at, order=order, name="_place", bucket=bucket)
    other = placed.select(*keys, (F.col("_place") + back).alias("_place"), F.col(value).alias(name))
    return placed.join(other, [*keys, "_place"], "left").drop("_place")


def uptimes(rows: DataFrame, keys: list[str], *, at: str, gap: str, bucket: int = BUCKET) -> DataFrame:
    """(keys, session, first, last, n): rows of a key at most ``gap`` apart belong together; those without key or time to none."""
    many = rows.where(F.col(at).isNotNull()).dropna(subset=keys).groupBy(*keys, F.col(at).alias("_ts")).agg(F.count("*").alias("n"))
    moments = many.withColumn("at", _micros("_ts")).withColumn("own", F.col("at"))
    ahead = _carry(moments.select(*keys, "at", "own"), keys, bucket, _last, _latest, own=False)
    new = F.col("at") > F.col("upto") + F.unix_micros(F.expr(f"timestamp_seconds(0) + interval {gap}"))
    begins = ahead.select(*keys, "at", F.coalesce(new.cast("long"), F.lit(0)).alias("own"))
    sessions = _carry(begins, keys, bucket, _sum, _add).withColumnRenamed("upto", "session")
    return moments.join(sessions, [*keys, "at"]).groupBy(*keys, "session").agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.sum("n").alias("n"))


def _numbered(rows: DataFrame, keys: list[str], at: str, order: str, name: str, bucket: int) -> DataFrame:
    """``rows`` with their place in the queue of their key by (at, order), from 1."""
    each = rows.withColumn("_at", _micros(at))
    many = each.groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    upto = counts_upto(many.select(*keys, F.col("_at").alias("at"), F.col("_n").alias("own")), many.select(*keys, F.col("_at").alias("at")), keys, bucket)
    first = many.join(upto.withColumnRenamed("at", "_at"), [*keys, "_at"]).select(*keys, "_at", (F.col("upto") - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_at").orderBy(order))
    return each.withColumn("_inside", inside).join(first, [*keys, "_at"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_inside", "_before")


def _then(f: Column, g: Column) -> Column:
    """What two steps do to the number of grants gone, one after the other; a step is c -> min(max(c + by, low), high)."""
    cut = lambda x: F.least(F.greatest(x + g["by"], g["low"]), g["high"]).cast("long")
    return F.struct((f["by"] + g["by"]).alias("by"), cut(f["low"]).alias("low"), cut(f["high"]).alias("high"))


def _gone_before(steps: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n, gone): grants that are gone before the n-th (from 0, ``most`` at most) of each key's ``steps`` (keys, n, step)."""
    runs = steps.groupBy(*keys, F.floor(F.col("n") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("n", "step"))).alias("steps"))  # RUN rows at most
    if most < RUN:
        runs = runs.withColumn("gone", F.lit(0).cast("long"))
    else:
        none = F.struct(F.lit(0).cast("long").alias("by"), F.lit(0).cast("long").alias("low"), F.lit(1 << 62).cast("long").alias("high"))
        runs = runs.checkpoint()
        whole = runs.select(*keys, F.col("run").alias("n"), F.aggregate("steps", none, lambda f, x: _then(f, x["step"])).alias("step"))
        runs = runs.join(_gone_before(whole, keys, most // RUN).withColumnRenamed("n", "run"), [*keys, "run"])
    start = lambda gone: F.struct(gone.alias("gone"), F.array().cast("array<long>").alias("all"))
    after = lambda c, s: F.least(F.greatest(c + s["by"], s["low"]), s["high"]).cast("long")
    scan = F.aggregate("steps", start(F.col("gone")), lambda a, x: F.struct(after(a["gone"], x["step"]).alias("gone"), F.concat(a["all"], F.array(a["gone"])).alias("all")), lambda a: a["all"])
    got = runs.select(*keys, F.inline(F.arrays_zip("steps", scan.alias("gone"))))
    return got.select(*keys, F.col("steps.n").alias("n"), "gone")


def match_queues(waiters: DataFrame, grants: DataFrame, keys: list[str], *, at: str, lifetime: str, bucket: int = BUCKET) -> DataFrame:
    """``waiters`` (keys, waiter_id, at) with the ``grant_id`` that serves them: the oldest of their key that is neither used nor over.

    Both queues go by (at, id); a grant may be used from its time until before ``lifetime`` later, so of all grants up to a
    waiter some are over; the number gone moves by one with each waiter, but not below the number over nor beyond the number
    there.  Such steps can be put together in any bracketing, so they are folded in runs of a bounded length instead of being
    replayed; waiters of one moment see the same grants and are one step.  A waiter without a grant has null and does not wait;
    null keys and times are served nothing."""
    known = lambda df: df.where(F.col(at).isNotNull()).dropna(subset=keys).withColumn("_at", _micros(at))
    inside = lambda order: F.row_number().over(W.partitionBy(*keys, "_at").orderBy(order))
    life = F.unix_micros(F.expr(f"timestamp_seconds(0) + interval {lifetime}"))
    shared_dir(waiters.sparkSession)  # where checkpoints go
    queue, line = known(grants), known(waiters)
    moments = lambda df: df.groupBy(*keys, F.col("_at").alias("at")).agg(F.count("*").alias("own")).checkpoint()
    arrive, asked = moments(queue), moments(line)
    upto = lambda events, moments, name: counts_upto(events, moments.select(*keys, "at"), keys, bucket).withColumnRenamed("upto", name)
    there = upto(arrive, asked, "there")
    over = upto(arrive.withColumn("at", F.col("at") + life), asked, "over")
    nth = upto(asked.withColumn("own", F.lit(1).cast("long")), asked, "n")
    steps = asked.join(there, [*keys, "at"]).join(over, [*keys, "at"]).join(nth, [*keys, "at"])
    steps = steps.select(*keys, F.col("at").alias("_at"), "own", "there", "over", (F.col("n") - 1).alias("n")).checkpoint()
    low = F.least(F.col("over") + F.col("own"), "there")  # each after the first is one step further
    step = F.struct(F.col("own").alias("by"), low.alias("low"), F.col("there").alias("high"))
    most = steps.agg(F.max("n")).first()[0] or 0
    gone = steps.join(_gone_before(steps.select(*keys, "n", step.alias("step")), keys, most), [*keys, "n"]).select(*keys, "_at", "there", "over", "gone")

    # of the waiters of a moment, the k-th takes the grant k places after those gone or over before the moment
    place = F.greatest("gone", "over") + F.col("_inside")
    served = line.withColumn("_inside", inside("waiter_id")).join(gone, [*keys, "_at"]).where(place <= F.col("there")).select(*keys, "waiter_id", place.alias("place"))
    before = upto(arrive, arrive, "upto").join(arrive, [*keys, "at"]).select(*keys, F.col("at").alias("_at"), (F.col("upto") - F.col("own")).alias("_before"))
    queue = queue.withColumn("_inside", inside("grant_id")).join(before, [*keys, "_at"]).select(*keys, "grant_id", (F.col("_before") + F.col("_inside")).alias("place"))
    return waiters.join(served.join(queue, [*keys, "place"]).drop("place"), [*keys, "waiter_id"], "left")
