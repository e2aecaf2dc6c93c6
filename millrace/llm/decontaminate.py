"""Benchmark decontamination by template windows: numbers, names and units become typed placeholders.

Each text is canonicalised word by word: a number, a capitalised word inside a sentence and a unit after a number turn
into placeholders, other words lose outer ASCII punctuation and case.  Windows of ``window`` canonical words are hashed
and joined with the benchmark's.  A match holds only if its slots agree: on one alignment of a document and an item,
equal benchmark values must stand for equal document values.  So a question asked again with other numbers or names is
found, while texts that share no more than a pattern with contradicting values are not.

In text capitalised throughout every word looks like a name, so words without case and placeholders are compared next to
the templates: a verbatim window counts for documents and items that no template joins.

A first pass over all documents only looks for anchors.  A window has at least one run of neighbouring literal words, and
those are equal in case-less form in every text that holds the window; of each benchmark window, the longest run of up to
``GRAM`` neighbours is looked up in all documents.  Templates and verbatim windows are made for the documents found so.

Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import SPACES, Scratch

# Unit words.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "mi", "g", "mg", "kg", "lb", "oz", "t", "ml", "l", "s", "min", "h", "hours", "hour", "minutes",
    "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "meters", "metres", "miles",
    "dollars", "euros", "cents", "usd", "eur", "percent", "degrees", "kmh", "mph", "w", "kw", "v", "a", "hz", "gb", "mb", "kb",
)
#: Characters that end a part of a word in anchors: ASCII but for letters and digits.
_CUT = r"[\x00-/:-@\[-`{-\x7f]+"
#: Parts of words in an anchor, at most.
GRAM = 3
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
_PUNCT = r"[!-/:-@\[-`{-~]"
#: Benchmark windows, and matched documents, up to which they are sent to all executors; beyond it they are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words between ASCII white space, as they stand."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def canonical(text: Column) -> Column:
    """One canonical word for each of ``words``; a word of punctuation alone becomes an empty string."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    s = F.concat(F.lit(" "), flat, F.lit(" "))
    s = F.regexp_replace(s, rf"(?<=[^ .!?] ){_PUNCT}*+[A-Z][^ ]*+", NAME)
    s = F.regexp_replace(s, rf"(?<= ){_PUNCT}*[0-9][0-9.,:/]*{_PUNCT}*(?= )", NUMBER)
    s = F.regexp_replace(s, rf"(?<= {NUMBER} ){_PUNCT}*(?:{'|'.join(UNITS)}){_PUNCT}*(?= )", UNIT)
    s = F.lower(F.regexp_replace(s, rf"(?<= ){_PUNCT}++|{_PUNCT}++(?= )", ""))
    parts = F.split(s, " ")
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 2, F.size(parts) - 2))


def literal(text: Column) -> Column:
    """One lower-case word without outer punctuation for each of ``words``."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    s = F.concat(F.lit(" "), F.lower(flat), F.lit(" "))
    parts = F.split(F.regexp_replace(s, rf"(?<= ){_PUNCT}++|{_PUNCT}++(?= )", ""), " ")
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 2, F.size(parts) - 2))


def _windows(tokens: Column, window: int) -> Column:
    """Hashes of all windows, in order."""
    at = F.sequence(F.lit(1), F.size(tokens) - window + 1)
    return F.when(F.size(tokens) >= window, F.transform(at, lambda i: F.xxhash64(F.slice(tokens, i, window))))


def _grams(parts: Column, n: int) -> Column:
    """Hashes of ``n`` neighbours from each position on; fewer at the end."""
    if n == 1:
        return F.transform(parts, lambda x: F.xxhash64(x))
    return F.transform(parts, lambda x, i: F.xxhash64(x, *[F.get(parts, i + k) for k in range(1, n)]))


def _core(word: Column) -> Column:
    return F.regexp_replace(word, rf"^{_PUNCT}+|{_PUNCT}+$", "")


def _anchors(words_: Column, is_literal) -> Column:
    """(n, chars, gram) of a window's best anchor: the most parts up to GRAM, then the most characters."""
    flat = F.array_join(F.transform(words_, lambda x: F.when(is_literal(x), x).otherwise(F.lit(NAME))), " ")
    runs = F.transform(F.split(flat, NAME), lambda r: F.filter(F.split(r, _CUT), lambda x: x != ""))
    return F.array_max(F.concat(*[F.flatten(F.transform(runs, _candidates(n))) for n in range(1, GRAM + 1)]))


def _candidates(n: int):
    """All runs of ``n`` neighbours in an array of parts, as (n, chars, gram)."""

    def at(parts: Column, i: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), F.length(F.array_join(F.slice(parts, i, n), "")).alias("chars"), F.xxhash64(*[F.get(parts, i - 1 + k) for k in range(n)]).alias("gram"))

    def pick(parts: Column) -> Column:
        starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: at(parts, i))

    return pick


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _bench(items: DataFrame, item: str, tokens: Column, extra: Column, window: int, literals: int, is_literal) -> DataFrame:
    """(i, g, ip, m, ic, iw): windows of the items, or a whole item that is shorter, with enough literal words."""
    rows = items.where(F.col(item).isNotNull()).select(F.col(item).alias("i"), tokens.alias("c"), extra.alias("w"))
    rows = rows.withColumn("g", F.xxhash64("w")).withColumn("m", F.least(F.size("c"), F.lit(window))).where(F.col("m") >= literals)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("c") - F.col("m"))).alias("ip"))
    rows = rows.select("i", "g", "ip", "m", F.slice("c", F.col("ip") + 1, F.col("m")).alias("ic"), F.slice("w", F.col("ip") + 1, F.col("m")).alias("iw"))
    return rows.where(F.size(F.filter("ic", is_literal)) >= literals)


def _aligned(rows: DataFrame, bench: DataFrame, tokens: Column, window: int) -> DataFrame:
    """(d, f, i, g, shift, ip, ic, iw, dw): windows of the documents ``rows`` that equal one of ``bench``."""
    keys = bench.select("m", F.xxhash64("ic").alias("h")).distinct()
    sizes = [r.m for r in keys.select("m").distinct().collect()]  # one to ``window``
    hashes = rows.select("d", "f", tokens.alias("c"))
    parts = [hashes.select("d", "f", F.lit(m).alias("m"), F.posexplode(_windows(F.col("c"), m)).alias("dp", "h")) for m in sizes or [window]]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = found.join(_small(keys), ["m", "h"], "left_semi").groupBy("d", "f").agg(F.collect_list(F.struct("m", "dp", "h")).alias("at"))
    # windows are cut before they are listed, so that no listed row holds a whole text
    texts = found.join(rows, ["d", "f"]).select("d", "f", "at", tokens.alias("c"), words(F.col("t")).alias("w"))
    cut = lambda x: F.struct(
        x["m"].alias("m"), x["dp"].alias("dp"), x["h"].alias("h"), F.slice("c", x["dp"] + 1, x["m"]).alias("dc"), F.slice("w", x["dp"] + 1, x["m"]).alias("dw")
    )
    listed = texts.select("d", "f", F.explode(F.transform("at", cut)).alias("x")).select("d", "f", "x.*")
    both = listed.join(bench.withColumn("h", F.xxhash64("ic")), ["m", "h"]).where("dc = ic")  # the words themselves, not only their hashes
    return both.select("d", "f", "i", "g", (F.col("dp") - F.col("ip")).cast("long").alias("shift"), "ip", "ic", "iw", "dw")


def matches(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
            window: int = 8, literals: int = 5) -> DataFrame:
    """(key, item, shift, n_windows, n_slots): consistent alignments of documents and benchmark items, by templates or else
    by verbatim windows, which have no slots.

    ``n_windows`` counts the windows of the alignment, ``n_slots`` its distinct slot values.  On one alignment equal
    benchmark values stand for equal document values, and equal names and units of the document for equal ones of the
    benchmark; numbers may coincide.  An item shorter than a window is matched whole.  Windows and items with fewer than
    ``literals`` ordinary words are no evidence and left out, as are rows with a null or empty text or a null key.  Rows
    that repeat a key or an item are matched one by one and merged by their ids; if alignments tie, all are returned.
    Empty tables give an empty result; other columns play no part, whatever their names; texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    ordinary = lambda x: ~x.isin("", NAME, NUMBER, UNIT)
    no_number = lambda x: ~x.rlike(r"^[0-9.,:/]*$")
    source = F.col(item_text)
    bench = scratch.save(_bench(items, item, canonical(source), words(source), window, literals, ordinary))
    verbatim = scratch.save(_bench(items, item, literal(source), words(source), window, literals, no_number))
    anchors = bench.select(_anchors(F.col("ic"), ordinary).alias("a")).union(verbatim.select(_anchors(F.col("ic"), lambda x: x != "").alias("a")))
    anchors = scratch.save(anchors.select("a.n", "a.gram").where("n is not null").distinct(), bench.count() + verbatim.count())
    lengths = sorted(r.n for r in anchors.select("n").distinct().collect())  # of 1 to GRAM

    rows = docs.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("d"), F.col(text).alias("t"))
    rows = rows.withColumn("f", F.xxhash64("t"))
    # the parts of the words are a column of their own, so that they are made once and not for each gram
    parts = rows.select("d", "f", F.split(F.lower("t"), _CUT).alias("p"))
    hits = rows.select("d", "f").limit(0)
    for n in lengths:
        grams = parts.select("d", "f", F.explode(_grams(F.col("p"), n)).alias("gram"))
        hits = hits.union(grams.join(_small(anchors.where(F.col("n") == n).select("gram")), "gram", "left_semi").select("d", "f"))
    hits = scratch.save(hits.distinct())
    rows = scratch.save(rows.join(_small(hits), ["d", "f"], "left_semi").dropDuplicates(["d", "f"]))

    at = ["d", "f", "i", "g", "shift"]
    both = _aligned(rows, bench, canonical(F.col("t")), window)
    slot = F.filter(
        F.zip_with("ic", F.arrays_zip("iw", "dw"), lambda c, v: F.struct(c.alias("kind"), _core(v["iw"]).alias("iv"), _core(v["dw"]).alias("dv"))),
        lambda x: x["kind"].isin(NAME, NUMBER, UNIT),
    )
    both = scratch.save(both.select(*at, "ip", slot.alias("slots")))
    runs = both.groupBy(at).agg(F.countDistinct("ip").alias("n_windows"))
    values = both.select(*at, F.explode("slots").alias("s")).select(*at, "s.kind", "s.iv", "s.dv").distinct()
    forth = values.groupBy(*at, "kind", "iv").agg(F.count("*").alias("n")).groupBy(at).agg(F.max("n").alias("most"), F.count("*").alias("n_slots"))
    back = values.where(F.col("kind") != NUMBER).groupBy(*at, "kind", "dv").agg(F.count("*").alias("n")).groupBy(at).agg(F.max("n").alias("most_back"))
    runs = runs.join(forth, at, "left").join(back, at, "left").where("coalesce(most, 1) = 1 and coalesce(most_back, 1) = 1")
    runs = scratch.save(runs.select("d", "i", "shift", "n_windows", "n_slots"))
    plain = _aligned(rows, verbatim, literal(F.col("t")), window).groupBy(at).agg(F.countDistinct("ip").alias("n_windows"))
    plain = plain.select("d", "i", "shift", "n_windows", F.lit(0).cast("long").alias("n_slots"))
    runs = runs.union(plain.join(runs.select("d", "i").distinct(), ["d", "i"], "left_anti").select(*runs.columns))
    return runs.select(F.col("d").alias(key), F.col("i").alias(item), "shift", "n_windows", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item: str = "item_id", **options) -> DataFrame:
    """(key, item, n_windows, n_slots) of the best alignment of each document and item."""
    found = matches(docs, items, key=key, item=item, **options)
    return found.groupBy(key, item).agg(F.max(F.struct("n_windows", "n_slots")).alias("best")).select(key, item, "best.n_windows", "best.n_slots")


def clean(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with all their columns, less those that hold a benchmark item's window.

    Rows with a null key or text stay; of rows that repeat a key, all go if one holds a window.  See ``matches``."""
    found = Scratch(docs.sparkSession, "decontaminate").save(leaks(docs, items, key=key, **options).select(key).distinct(), docs.count())
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, key, "left_anti")


def sql(window: int = 8, literals: int = 5) -> str:
    """DuckDB SQL for ``leaks`` of the benchmark in the documents table."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    punct = r"[!-/:-@\[-`{-~]"

    def side(name: str, table: str, key: str) -> str:
        return f"""
{name}0 as (select {key} as k, string_split(trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') as w from {table}
  where {key} is not null and trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') <> ''),
{name}1 as (select k, w, list_transform(w, lambda x: regexp_replace(x, '^{punct}+|{punct}+$', '', 'g')) as core from {name}0),
{name}2 as (select k, w, core, list_transform(range(1, len(w) + 1), lambda i:
    case when i > 1 and regexp_matches(core[i], '^[A-Z]') and not regexp_matches(w[i - 1], '[.!?]$') then '@N'
         when regexp_matches(w[i], '^{punct}*[0-9][0-9.,:/]*{punct}*$') then '@D'
         else core[i] end) as c1 from {name}1),
{name}3 as (select k, core, list_transform(core, lambda x: lower(x)) as l, list_transform(range(1, len(w) + 1), lambda i:
    case when i > 1 and c1[i - 1] = '@D' and c1[i] in ({units}) then '@U' when c1[i] in ('@N', '@D') then c1[i] else lower(c1[i]) end) as c from {name}2)"""

    cut = "c[p:p + m - 1] as cw, l[p:p + m - 1] as lw, core[p:p + m - 1] as vw"
    return f"""
with {side("b", "benchmark", "item_id")},
b as (select k, p, m, {cut} from (select *, unnest(range(1, len(c) - m + 2)) as p from (select *, least({window}, len(c)) as m from b3) where m >= {literals})),
sizes as (select distinct m from b),
{side("d", "documents", "doc_id")},
d as (select k, p, m, {cut} from (select *, unnest(range(1, len(c) - m + 2)) as p from d3, sizes where len(c) >= m)),
m as (select d.k as doc_id, b.k as item_id, d.p - b.p as shift, b.p as ip, b.cw as cw, b.vw as iv, d.vw as dv, b.m as m
  from d join b on d.cw = b.cw where len(list_filter(b.cw, lambda x: x not in ('', '@N', '@D', '@U'))) >= {literals}),
runs as (select doc_id, item_id, shift, count(distinct ip) as n_windows from m group by all),
slots as (select distinct doc_id, item_id, shift, cw[j] as kind, iv[j] as iv, dv[j] as dv
  from (select *, unnest(range(1, m + 1)) as j from m) where cw[j] in ('@N', '@D', '@U')),
vals as (select doc_id, item_id, shift, max(n) as most, count(*) as n_slots from (
  select doc_id, item_id, shift, kind, iv, count(*) as n from slots group by all) group by doc_id, item_id, shift),
back as (select doc_id, item_id, shift, max(n) as most_back from (
  select doc_id, item_id, shift, kind, dv, count(*) as n from slots where kind <> '@D' group by all) group by doc_id, item_id, shift),
good as (select r.doc_id, r.item_id, r.n_windows, coalesce(v.n_slots, 0) as n_slots
  from runs r left join vals v using (doc_id, item_id, shift) left join back w using (doc_id, item_id, shift)
  where coalesce(v.most, 1) = 1 and coalesce(w.most_back, 1) = 1),
plain as (select d.k as doc_id, b.k as item_id, d.p - b.p as shift, count(distinct b.p) as n_windows, 0 as n_slots
  from d join b on d.lw = b.lw where len(list_filter(b.lw, lambda x: not regexp_matches(x, '^[0-9.,:/]*$'))) >= {literals} group by all),
every as (select * from good union all select doc_id, item_id, n_windows, n_slots from plain anti join good using (doc_id, item_id))
select doc_id, item_id, max(n_windows)::bigint as n_windows, arg_max(n_slots, n_windows * 1000000 + n_slots)::bigint as n_slots from every group by doc_id, item_id
"""
