"""Temperature mixing of sources: weights from exponentiated token shares, realised as budgeted block permutations.

Weights are ``share ** a / sum(share ** a)``.  The exponent ``a`` in [0, 1] is the largest whose weights reach the
target entropy, raised where needed so that no source is repeated more often than allowed; it is found by interval
section, each round evaluating 33 exponents in one pre-aggregated pass over the sources.  A source's weight times the
budget is its quota: whole permutations of its documents, each epoch in another order, and a prefix of one more.
Documents go to blocks by their place in the quota, so each block holds the target weights, and each block is shuffled.

Only built-in functions are used.  Prefix sums run in two levels (buckets, then documents of a bucket), so a source
with a third of all documents is never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.shared import SPACES, Scratch

#: Exponents tried in each round are this many steps apart, and the rounds of narrowing.
STEPS, ROUNDS = 32, 4
#: Documents of a bucket of a permutation, on average.
BUCKET = 512


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    edges = text.rlike(f"^{SPACES}").cast("int") + text.rlike(f"{SPACES}$").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, SPACES)) - edges).cast("long")


def _section(shares: DataFrame, measure: Column, good) -> float:
    """The exponent in [0, 1] where ``good`` stops (it holds from 0 up) after ROUNDS narrowings; -1 if it never holds."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda j: F.lit(lo) + F.lit(hi - lo) * j / F.lit(float(STEPS))))
        tried = shares.select("share", "tokens", at.alias("a"))
        sums = tried.groupBy("a").agg(
            F.sum(F.exp(F.col("a") * F.log("share"))).alias("z"),
            F.sum(F.exp(F.col("a") * F.log("share")) * F.log("share")).alias("s"),
            F.max(F.exp(F.col("a") * F.log("share")) / F.col("tokens")).alias("top"),
        )
        rows = sums.select("a", measure.alias("v")).orderBy("a").collect()  # 33 rows
        held = [r.a for r in rows if good(r.v)]
        if not held:
            return -1.0
        lo, hi = max(held), min([r.a for r in rows if r.a > max(held)], default=max(held))
        if hi == lo:
            break
    return lo


def weights(docs: DataFrame, *, source: str = "source", size: str = "n_words", entropy: float = 0.98, max_repeats: float = 4.0,
            budget: int | None = None) -> tuple[DataFrame, float]:
    """((source, docs, tokens, weight, quota), exponent) for sources that hold tokens.

    ``entropy`` is the target as a part of the largest possible entropy, the logarithm of the number of sources;
    ``budget`` is in tokens, all tokens unless given.  A null source is one source.
    """
    per = docs.groupBy(F.col(source)).agg(F.count("*").alias("docs"), F.sum(size).alias("tokens")).where("tokens > 0")
    per = Scratch(docs.sparkSession, "mixing").save(per)
    n, total = per.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return per.select(source, "docs", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota")), 1.0
    budget = int(total) if budget is None else budget
    shares = per.withColumn("share", F.col("tokens") / F.lit(float(total)))
    spread = _section(shares, F.log("z") - F.col("a") * F.col("s") / F.col("z"), lambda v: v >= entropy * math.log(n) - 1e-9)
    over = _section(shares, F.col("top") / F.col("z") * F.lit(float(budget)), lambda v: v > max_repeats + 1e-9)
    step = 1.0 / STEPS**ROUNDS
    a = max(spread, 0.0) if over < 0 else min(1.0, max(spread, over + step))
    z = float(shares.agg(F.sum(F.exp(F.lit(a) * F.log("share")))).first()[0])
    weight = F.exp(F.lit(a) * F.log("share")) / F.lit(z)
    return shares.select(source, "docs", "tokens", weight.alias("weight"), F.floor(weight * F.lit(float(budget)) + 1e-3).cast("long").alias("quota")), a


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", entropy: float = 0.98,
        max_repeats: float = 4.0, budget: int | None = None, block_tokens: int = 250_000, seed: int = 0) -> DataFrame:
    """(key, source, epoch, block, position, n_words): one row per time that a document is used.

    Documents without words take no part.  The key and the source may be called anything but epoch, block, position and
    n_words; other columns play no part.  Texts are read whole, and each of repeated rows is a document.  Rows with equal keys are ordered by their size; a null key is written as
    an empty string in the permutation.  An empty table gives no rows.
    """
    sized = docs.select(F.col(key), F.col(source).alias("_s"), n_words(F.col(text)).alias("n_words")).where("n_words > 0")
    sized = Scratch(docs.sparkSession, "mixing").save(sized)
    plan, _ = weights(sized, source="_s", entropy=entropy, max_repeats=max_repeats, budget=budget)
    plan = plan.where("quota > 0")
    blocks = max(1, -(-(plan.agg(F.sum("quota")).first()[0] or 0) // block_tokens))
    plan = plan.select(F.col("_s").alias("_p"), "docs", "tokens", "quota", F.lit(blocks).cast("long").alias("_blocks"))
    # the plan has a row for each source; Spark sends it to all tasks only where it is small
    rows = sized.join(plan, F.col("_s").eqNullSafe(F.col("_p"))).drop("_p")
    epochs = F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("tokens")).cast("int"))).alias("epoch")
    rows = rows.select("*", epochs)
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("epoch").cast("string"))
    rows = rows.withColumn("_h", F.md5(name))
    part = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.ceil(F.col("docs") / BUCKET)
    rows = rows.withColumn("_b", F.floor(part / F.lit(4294967296.0)).cast("long"))
    sums = rows.groupBy("_s", "epoch", "_b").agg(F.sum("n_words").alias("_t"))
    ahead = W.partitionBy("_s", "epoch").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("_s").alias("_s2"), F.col("epoch").alias("_e2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_ahead"))
    rows = rows.join(sums, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("epoch") == F.col("_e2")) & (F.col("_b") == F.col("_b2")))
    inside = W.partitionBy("_s", "epoch", "_b").orderBy("_h", "n_words").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("epoch") * F.col("tokens") + F.col("_ahead") + F.coalesce(F.sum("n_words").over(inside), F.lit(0)))
    rows = rows.where(F.col("_at") + F.col("n_words") <= F.col("quota"))
    rows = rows.withColumn("block", F.floor(F.col("_at").cast("double") * F.col("_blocks") / F.col("quota")).cast("long"))
    place = W.partitionBy("block").orderBy(F.md5(F.concat_ws(":", F.lit("block"), "_h")), "n_words")
    return rows.select(key, F.col("_s").alias(source), "epoch", "block", F.row_number().over(place).cast("long").alias("position"), "n_words")


def sql(entropy: float = 0.98, max_repeats: float = 4.0, block_tokens: int = 250_000) -> str:
    """DuckDB SQL for ``mix`` over the documents table with its defaults."""
    words = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
    parts = [
        f"sized as (select * from (select doc_id, source as _s, {words} as n_words from documents) where n_words > 0)",
        "per as (select _s, count(*) as docs, sum(n_words)::bigint as tokens from sized group by _s)",
        "total as (select count(*) as n, sum(tokens)::double as t from per)",
        "shares as (select _s, docs, tokens, tokens / t as share, n, t from per, total)",
    ]
    for kind, measure, good in (
        ("h", "ln(z) - a * s / z", f"v >= {entropy} * ln(n) - 1e-9"),
        ("r", "top / z * t", f"v > {max_repeats} + 1e-9"),
    ):
        parts.append(f"{kind}0 as (select 0.0::double as lo, 1.0::double as hi, true as ok)")
        for k in range(ROUNDS):
            parts.append(
                f"{kind}t{k} as (select a, any_value(n) as n, any_value(t) as t, sum(exp(a * ln(share))) as z, "
                f"sum(exp(a * ln(share)) * ln(share)) as s, max(exp(a * ln(share)) / tokens) as top, any_value(ok) as ok0 "
                f"from shares, (select distinct lo + (hi - lo) * j / {STEPS}.0::double as a, ok from {kind}{k}, range({STEPS + 1}) r(j)) group by a)"
            )
            parts.append(f"{kind}v{k} as (select a, ok0, {good} as g from (select *, {measure} as v from {kind}t{k}))")
            parts.append(
                f"{kind}{k + 1} as (select lo, coalesce((select min(a) from {kind}v{k} where a > lo), lo) as hi, ok from "
                f"(select coalesce(max(a) filter (g), -1.0) as lo, bool_and(ok0) and count(*) filter (g) > 0 as ok from {kind}v{k}))"
            )
    last = ROUNDS
    parts += [
        f"pick as (select case when not r.ok then greatest(case when h.ok then h.lo else -1.0 end, 0.0) else "
        f"least(1.0, greatest(case when h.ok then h.lo else -1.0 end, r.lo + {1.0 / STEPS**ROUNDS!r})) end as a from h{last} h, r{last} r)",
        "zed as (select a, sum(exp(a * ln(share))) as z from shares, pick group by a)",
        "plan0 as (select _s, docs, tokens, floor(exp(a * ln(share)) / z * t + 1e-3)::bigint as quota from shares, zed)",
        f"plan as (select *, greatest(1, ceil((select sum(quota) from plan0) / {block_tokens}))::bigint as blocks from plan0 where quota > 0)",
        "rows0 as (select s.doc_id, s._s, s.n_words, p.docs, p.tokens, p.quota, p.blocks, "
        "unnest(range(0, cast(floor((p.quota - 1) / p.tokens::double) as bigint) + 1)) as epoch from sized s join plan p on s._s is not distinct from p._s)",
        "rows1 as (select *, md5('0:' || coalesce(doc_id::varchar, '') || ':' || epoch::varchar) as h from rows0)",
        f"rows2 as (select *, floor(cast('0x' || substr(h, 1, 8) as bigint) * ceil(docs / {BUCKET}.0) / 4294967296.0)::bigint as b from rows1)",
        "rows3 as (select *, epoch * tokens + coalesce(sum(n_words) over (partition by _s, epoch order by b, h, n_words "
        "rows between unbounded preceding and 1 preceding), 0)::bigint as pos from rows2)",
        "rows4 as (select *, floor(pos::double * blocks / quota)::bigint as block from rows3 where pos + n_words <= quota)",
    ]
    return "with " + ",\n".join(parts) + (
        "\nselect doc_id, _s as source, epoch::int as epoch, block, row_number() over (partition by block order by md5('block:' || h), n_words) as position, "
        "n_words::bigint as n_words from rows4"
    )
