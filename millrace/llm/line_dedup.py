"""Line dedup by site-relative frequency: lines that more than a share of a site's documents contain are dropped.

A site is any grouping column (host, source).  A line counts once per document; blank lines are never dropped.
Documents are counted per (site, line hash) with map-side partial counts, so a hot site or line does not gather
anywhere.  The marked lines of a site number at most its mean distinct lines per document divided by ``ratio``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch

#: Marked lines up to which they are sent to all executors (16 bytes each), and sites; beyond it, lines are joined by shuffles.
BROADCAST_LINES = 200_000


def _site(site: Column) -> Column:
    """A non-null key for the site; null is a site of its own."""
    return F.coalesce(F.concat(F.lit("s"), site.cast("string")), F.lit("n"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _marks(lines: Column) -> Column:
    """128 bits for each line."""
    return F.transform(lines, lambda x: F.unhex(F.md5(x)))


def boilerplate(docs: DataFrame, *, site: str = "source", text: str = "text", ratio: float = 0.1, min_docs: int = 3) -> DataFrame:
    """(site, line): marks of the lines in more than ``ratio`` of a site's documents, and in ``min_docs`` at least."""
    uniq = F.array_distinct(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""))
    seen = docs.select(_site(F.col(site)).alias("site"), F.explode(_marks(uniq)).alias("line"))
    counts = seen.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    total = Scratch(docs.sparkSession, "line-dedup").save(docs.groupBy(_site(F.col(site)).alias("site")).agg(F.count("*").alias("total")))
    if total.count() <= BROADCAST_LINES:
        total = F.broadcast(total)
    return counts.join(total, "site").where(F.col("n") > ratio * F.col("total")).select("site", "line")


def dedup(docs: DataFrame, *, key: str = "doc_id", site: str = "source", text: str = "text", ratio: float = 0.1,
          min_docs: int = 3, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with the marked lines taken out of ``text`` and two more columns, ``n_lines`` and ``n_dropped``.

    All documents stay, even if nothing is left of their text, and in repeated rows each counts as a document.  A null text
    stays null with no lines, an empty one is one blank line; a line on exactly ``ratio`` of the documents stays.  Columns
    named ``n_lines`` or ``n_dropped`` are replaced, other names do not matter.  An empty table gives no rows.  Texts are
    read whole, and lines are compared by 128 bits.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    marks = scratch.save(boilerplate(docs, site=site, text=text, ratio=ratio, min_docs=min_docs))
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the caller's columns are one struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias("row"))
    body = F.col("row").getField(text)
    rows = rows.withColumn("site", _site(F.col("row").getField(site)))
    if marks.count() <= broadcast_lines:
        rows = rows.join(F.broadcast(marks.groupBy("site").agg(F.collect_set("line").alias("bad"))), "site", "left")
    else:
        lines = rows.select(F.col("row").getField(key).alias("k"), "site", F.explode(_marks(_lines(body))).alias("line"))
        hits = lines.join(marks, ["site", "line"]).groupBy("k", "site").agg(F.collect_set("line").alias("bad"))
        hits = scratch.save(hits.withColumnRenamed("site", "at"))
        rows = rows.join(hits, F.col("row").getField(key).eqNullSafe(F.col("k")) & (F.col("site") == F.col("at")), "left")
    bad, lines = F.col("bad"), _lines(body)
    kept = F.when(bad.isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(bad, F.unhex(F.md5(x)))))
    rows = rows.select("row", "bad", kept.alias("kept"), F.when(body.isNull(), 0).otherwise(F.size(lines)).alias("n"))
    new = F.when(body.isNull() | bad.isNull(), body).otherwise(F.array_join("kept", "\n"))
    return rows.select(
        *[(new if c == text else F.col("row").getField(c)).alias(c) for c in order], F.col("n").cast("long").alias("n_lines"),
        F.when(body.isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
    )


SQL = """
with lines as (
  select doc_id, source, string_split(coalesce(text, ''), chr(10)) as ls from documents),
seen as (
  select source, unnest(list_distinct(list_filter(ls, lambda x: trim(x, ' ') <> ''))) as line from lines),
total as (select source, count(*) as total from documents group by source),
marked as (
  select s.source, list(s.line) as bad from (
    select source, line, count(*) as n from seen group by source, line having count(*) >= 3) s
  join total t on s.source is not distinct from t.source where s.n > 0.1 * t.total group by s.source),
kept as (
  select l.doc_id, len(l.ls) as n_lines,
         list_filter(l.ls, lambda x: m.bad is null or not list_contains(m.bad, x)) as k
  from lines l left join marked m on l.source is not distinct from m.source)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_lines - len(k) as bigint) as n_dropped,
       sha256(array_to_string(k, chr(10))) as kept_sha256
from kept
"""
