"""N-gram Jaccard join with prefix filters under several global token orders.

A text's set holds its distinct word shingles.  Two sets that reach the threshold ``t`` share a token within the first
``n - ceil(t * n) + 1`` tokens of any global order; candidates must meet in the prefixes of ``ORDERS`` orders before they
are verified.  The *head* of a set in an order by hash is longer than the prefix by a
twentieth of the set and ``SLACK`` tokens, so that linked sets must share at least so many tokens of their heads (``_least``).
So a set of which fewer head tokens occur in another head can have no partner and drops out, which takes a fifth of the
tokens, and all of short texts.  For the sets left, the first order is by exact document frequency among them, rare tokens
first; a token that only one of them holds takes its place in the prefix without being indexed.  The others are by hash.

Steps, all distributed:

1. one pass over the texts gives each set's size, 128-bit fingerprint and head; equal sets are represented by their smallest id;
2. head tokens are counted with partial aggregation, and the repeated ones are counted for each set;
3. the sets left are read again, with all tokens and their prefixes in the orders by hash; their tokens are counted in the
   same way, and the first order's prefixes follow;
4. in a few rounds, each of them is verified against one centre outside its component, the pivot that most of its prefix
   tokens agree on;
5. the pairs left between different components, of sizes that can link and where enough tokens follow the common one, are
   verified if they meet in all orders; so a group of thousands of near copies costs a few comparisons per member, yet no
   link between components is missed;
6. connected components of the verified links.

Joins on tokens and ids read two written tables, so that Spark can split a frequent token or a set with many links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch, connected_components, mix64, word_hashes

#: Number of global orders whose prefixes must all meet.
ORDERS = 3
#: A head is longer than a prefix by one token in SPARE of the set and by SLACK.
SPARE, SLACK = 20, 32
#: Rounds in which each set is compared with one other set only, before pairs are joined.
STARS = 2
#: Ids up to which they are sent to all executors, instead of shuffling the texts.
BROADCAST_IDS = 500_000
#: Tokens of the sets that a Python worker holds at once.
HELD_TOKENS = 250_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z in lower case; with fewer words, of all as one."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = mix64(word_hashes(words))
    if len(words) < k:
        out = np.full(1, len(words), np.uint64)
        for x in h:
            out = mix64(out * _MIX[0] + x)
        return out
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out * _MIX[0] + h[i : i + n])
    return np.unique(out)


def _need(n: int, num: int, den: int) -> int:
    """Tokens of a set of ``n`` that any linked set shares."""
    return -(-num * n // den)


def _rest(n: int, num: int, den: int) -> int:
    """Tokens outside the head; it never falls as n grows."""
    return max(0, (SPARE * num - den) * n // (SPARE * den) - SLACK)


def _least(n: int, num: int, den: int) -> int:
    """Tokens that the heads of linked sets share at least.

    Of the common tokens, those outside a head come last by hash, so at most ``_rest`` of the larger set are lost.  Rounding
    may give the smaller set one more than the larger one, which the one less here makes up for.
    """
    return max(1, _need(n, num, den) - _rest(n, num, den) - 1)


def _sql_rest(n: str, num: int, den: int) -> str:
    return f"greatest(0L, ({SPARE * num - den}L * {n}) div {SPARE * den}L - {SLACK}L)"


def _order(tokens: np.ndarray, k: int) -> np.ndarray:
    """The tokens in the k-th order by hash; the tokens themselves are hashes, and 0 is their own order."""
    return tokens[np.argsort(mix64(tokens ^ _MIX[k]), kind="stable")] if k else tokens


def _marks(tokens: np.ndarray) -> tuple[int, int]:
    """The set's fingerprint as two signed integers."""
    mark = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return tuple(int(x) for x in np.array([mark >> 64, mark & ((1 << 64) - 1)], np.uint64).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))


def _column(values: list) -> pa.Array:
    """Integers, arrays of them, or lists of such arrays."""
    if isinstance(values[0], list):
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _lists([x for v in values for x in v]))
    return _lists(values) if isinstance(values[0], np.ndarray) else pa.array(values, pa.int64())


def _in_parts(batches, size, columns: list[str], make) -> Iterator[pa.RecordBatch]:
    """Rows that ``make`` gives for each text, as batches of a bounded number of tokens.  Texts are taken from Arrow one at a
    time, so a worker holds no second copy of what it is sent."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            got, n = make(*[x.as_py() for x in row])
            if got is not None:
                rows.append(got)
                held += n + size
            if held >= HELD_TOKENS:
                yield pa.RecordBatch.from_arrays([_column(c) for c in zip(*rows)], columns)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([_column(c) for c in zip(*rows)], columns)


def _heads(k: int, num: int, den: int):
    """(id, n, s1, s2, head) of each text."""

    def one(i, text):
        s = shingles(text, k)
        head = s[: len(s) - _rest(len(s), num, den)]
        return (i, len(s), *_marks(s), head.astype(np.int64)), len(head)

    return lambda batches: _in_parts(batches, 20, ["id", "n", "s1", "s2", "head"], one)


def _whole(k: int, num: int, den: int):
    """(id, n, tokens, prefixes) of the texts whose set has the fingerprint asked for."""

    def one(i, text, s1, s2):
        s = shingles(text, k)
        if _marks(s) != (s1, s2):
            return None, 0
        length = len(s) - _need(len(s), num, den) + 1
        prefixes = [_order(s, x)[:length].astype(np.int64) for x in range(1, ORDERS)]
        return (i, len(s), s.astype(np.int64), prefixes), len(s) + sum(map(len, prefixes))

    return lambda batches: _in_parts(batches, 20, ["id", "n", "tokens", "prefixes"], one)


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each list as a view of the column's values."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[i:j] for i, j in zip(ends, ends[1:]))


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b, na, nb, ta, tb = batch.columns
            sizes = na.to_numpy() + nb.to_numpy()
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(_rows(ta), _rows(tb))], np.int64)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(den * both >= num * (sizes - both)))

    return run


def _often(entries: DataFrame) -> DataFrame:
    """(token, df) of the tokens that two sets or more hold."""
    return entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")


def similar_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100,
                   scratch: Scratch | None = None) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``; linked where ``den * both >= num * union``.

    ``key`` is an integer.  Texts that are null or without words have an empty set, n_shingles 0 and stay alone.  Rows that
    repeat an id count as one document, judged by one of their texts, the one whose set is not empty and has the smallest
    fingerprint; each row is returned.  Rows with a null id are returned with size 0 and a null component.  An empty table
    gives an empty result.  Texts are read whole; other columns play no part, whatever their names.  Among equal texts the
    smallest id counts.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    rest = lambda n: _sql_rest(n, num, den)
    need = f"(({num}L * n + {den - 1}L) div {den}L)"
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")

    sets = scratch.save(rows.mapInArrow(_heads(k, num, den), "id long, n long, s1 long, s2 long, head array<long>"))
    texts = sets.count()  # bounds all tables of one row a text
    twice = scratch.save(sets.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), texts)
    repeats = twice.count() > 0
    if repeats:
        one = sets.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.expr("n = 0").alias("void"), "s1", "s2", "n", "head")).alias("v"))
        sets = scratch.save(sets.join(twice, "id", "left_anti").union(one.select("id", "v.n", "v.s1", "v.s2", "v.head")))
    same = scratch.save(sets.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("s1", "s2", "rep"), texts)
    members = scratch.save(sets.select("id", "n", "s1", "s2").join(same, ["s1", "s2"], "left").select("id", "n", "s1", "s2", F.coalesce("rep", "id").alias("rep")), texts)
    copies = small(members.where("id != rep").select("id"))

    heads = sets.where("n > 0").join(copies, "id", "left_anti").select("id", "n", F.explode("head").alias("token"))
    often = scratch.save(_often(heads).select("token"))
    asked = heads.join(often.hint("shuffle_hash"), "token", "left_semi").groupBy("id", "n").agg(F.count("*").alias("c"))
    asked = asked.where(F.expr(f"c >= greatest(1L, {need} - {rest('n')} - 1)")).select("id")
    asked = scratch.save(asked.join(members.select("id", "s1", "s2"), "id"), texts)
    scratch.drop(sets, often)
    nodes = rows.join(small(asked), "id").select("id", "text", "s1", "s2")
    nodes = nodes.mapInArrow(_whole(k, num, den), "id long, n long, tokens array<long>, prefixes array<array<long>>")
    nodes = scratch.save(nodes.dropDuplicates(["id"]) if repeats else nodes)

    every = nodes.select("id", "n", F.explode("tokens").alias("token"))
    often = scratch.save(_often(every))
    index = every.join(often.hint("shuffle_hash"), "token").groupBy("id", "n").agg(F.collect_list(F.struct("df", "token")).alias("e"))
    index = index.withColumn("lone", F.expr("n - size(e)")).where(F.expr(f"size(e) >= {need}"))
    index = index.select("id", "n", "lone", F.expr(f"slice(array_sort(e), 1, cast(n - {need} + 1 - lone as int))").alias("e"))
    index = scratch.save(index.select("id", "n", "lone", F.transform("e", lambda x: x["token"]).alias("prefix")), texts)
    scratch.drop(often)
    tokens = index.agg(F.sum(F.size("prefix"))).first()[0] or 0  # bounds all tables of one row a prefix token

    fits = F.expr(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    # what two sets can share from their first common token on, against what they must share
    reach = F.expr(f"{num + den} * least(na - pa, nb - pb) >= {num} * (na + nb)")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"), F.col("prefixes").alias(f"p{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        for j in range(ORDERS - 1):
            both = both.where(F.arrays_overlap(F.col("pa")[j], F.col("pb")[j]))
        return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_verify(num, den), "a long, b long")

    entries = index.select("id", "n", F.posexplode("prefix").alias("at", "token"), "lone").select("id", "n", "token", "lone", (F.col("lone") + F.col("at")).alias("p"))
    placed, links, tried = entries.withColumn("component", F.col("id")), None, None
    for r in range(STARS):
        central = F.col("lone") / F.col("n") if r == 0 else F.xxhash64("id", F.lit(r))
        pivot = F.min(F.struct(central.alias("rank"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("component").alias("ca")))
        mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pivot.alias("pivot")).where("lo < hi")
        mixed = scratch.save(mixed.select("token", "pivot.a", "pivot.na", "pivot.pa", "pivot.ca"), tokens)
        votes = placed.withColumnsRenamed({"n": "nb", "p": "pb"}).join(mixed, "token")
        votes = votes.where("component != ca").where(fits).where(reach).groupBy("id", "a").agg(F.count("*").alias("c"))
        star = votes.groupBy("id").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct()
        star = scratch.save(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), texts)
        new = scratch.save(verified(star), texts)
        links, tried = (new, star) if tried is None else (links.union(new), tried.union(star))
        if r == 0 or not new.isEmpty():
            edges = links.count()
            groups = scratch.save(connected_components(scratch, links, "a", "b", edges), 2 * edges)
        again = scratch.save(entries.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")), tokens)
        mixed = again.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        placed = scratch.save(again.join(scratch.save(mixed, tokens), "token", "left_semi"), tokens)
    # sizes by powers of 1 / t: the larger set of a pair is in the class of the smaller one or in the next
    size = lambda n: F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(den / num)) + 1e-9) if num < den else F.col(n)
    y = placed.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("component").alias("cb"), size("n").cast("long").alias("size"))
    x = placed.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("component").alias("ca"), size("n").cast("long").alias("s"))
    x = x.select("*", F.explode(F.array(F.col("s"), F.col("s") + 1)).alias("size"))
    pairs = x.join(y, ["token", "size"]).where("(na < nb or na = nb and a < b) and ca != cb").where(fits).where(reach)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.save(pairs.join(tried, ["a", "b"], "left_anti"))
    more = scratch.save(verified(pairs), pairs.count())
    if not more.isEmpty():
        links = links.union(more)
        edges = links.count()
        groups = scratch.save(connected_components(scratch, links, "a", "b", edges), 2 * edges)

    found = members.select("id", "rep", "n").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    found = scratch.save(found.select("id", "n", F.coalesce("component", "rep").alias("component_id")), texts)
    return docs.select(F.col(key)).join(found.withColumnRenamed("id", key), key, "left").select(
        key, F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", F.col(key).cast("long")).alias("component_id")
    )


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without those near copies that have a smaller id in their group; repeated rows of a kept id all stay, as do
    rows with a null id or text."""
    scratch = Scratch(docs.sparkSession, "keep-first")
    found = similar_groups(docs, key=key, text=text, k=k, num=num, den=den, scratch=scratch)
    gone = scratch.save(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), docs.count())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")


def sql(k: int = 4, num: int = 85, den: int = 100) -> str:
    """DuckDB SQL for ``similar_groups`` of the documents table: all pairs that share a shingle."""
    return f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {k} then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where {den} * p.c >= {num} * (x.n + y.n - p.c)),
e as (select a, b from l union all select b, a from l),
r as (select a as src, b as dst from e union select r.src, e.b from r join e on r.dst = e.a),
m as (select src, min(dst) as low from r group by src)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join m on m.src = d.doc_id
"""
