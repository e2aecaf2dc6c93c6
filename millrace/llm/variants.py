"""Spelling variants: words that differ by one edit, found by a positional q-gram index, and the form each of them goes back to.

One edit leaves one half of a word as it is, so the halves are long positional grams that deal words into groups; every pair
within one edit meets in the group of its equal half.  Groups that are large are dealt again by the halves of what the group
has not fixed yet, so no group grows with the input.  In a group, an inverted index holds the positional grams of two
characters of each word; the postings under a word's grams are heap-merged within the limits of length and position, and
words that share as many grams as one edit leaves are verified.
"""

from __future__ import annotations

import heapq
import itertools
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch

#: Latin-1 bytes of a text to lower case and letters alone; other characters of the text come as question marks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Words that a task counts before it hands them on.
_HELD = 500_000


def count_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_n: int = 3, slip: int = 97) -> DataFrame:
    """(word, n): runs of Latin letters in lower case, at least ``least_chars`` long and ``least_n`` times in the corpus.

    Where ``slip`` divides the checksum of document and run, one character of the run is left out, so that the corpus has
    variants to find.  Null texts have no words; a null key counts as an empty one; repeated rows count again."""

    def counted(found):  # a task without words yields strings as well
        return pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in found], dtype="object"), "n": pd.Series(list(found.values()), dtype="int64")})

    def run(batches):
        found: dict[bytes, int] = {}
        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text]):
                words = (t or "").encode("latin-1", "replace").translate(_LETTERS).split()
                start = zlib.crc32(f"{'' if pd.isna(k) else k}:".encode())
                here: dict[bytes, int] = {}
                for w in words:
                    here[w] = here.get(w, 0) + 1
                for w, n in here.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % slip == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= least_chars:
                        found[w] = found.get(w, 0) + n
            if len(found) > _HELD:
                yield counted(found)
                found = {}
        yield counted(found)

    rows = docs.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of (word, n, m, lo, hi, marks) twice: with the first and with the last half of its free part fixed.

    ``m`` is the length of the shorter word of a pair, ``lo`` and ``hi`` the characters fixed on either side, ``marks`` the
    parts that would have put a pair into an earlier group."""
    free = F.col("m") - F.col("lo") - F.col("hi")
    half = F.floor(free / 2).cast("int")
    here = F.concat_ws(",", F.when(F.col("marks") != "", F.col("marks")), F.concat_ws(":", "lo", half))
    first = F.struct((F.col("lo") + half).alias("lo"), F.col("hi"), F.col("marks"))
    last = F.struct(F.col("lo"), (F.col("hi") + free - half).alias("hi"), here.alias("marks"))
    both = rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("x")).select("word", "n", "m", "x.*")
    fixed = F.concat_ws("|", "m", "lo", "hi", "marks", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi")))
    return both.withColumn("fixed", fixed)


def _groups(scratch: Scratch, words: DataFrame, largest: int) -> DataFrame:
    """Words dealt into groups by what a pair has in common, until groups of more than ``largest`` words have no free part left."""
    alone = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"))
    rows = alone.withColumns({"lo": F.lit(0), "hi": F.lit(0), "marks": F.lit("")})
    dealt = None
    while True:
        level = scratch.save(_halves(rows))
        large = level.where(F.col("m") - F.col("lo") - F.col("hi") >= 2).groupBy("fixed").agg(F.count("*").alias("c")).where(F.col("c") > largest)
        large = scratch.save(large.select("fixed"))
        done = large.isEmpty()
        small = (level if done else level.join(large, "fixed", "left_anti")).select("fixed", "word", "n")
        dealt = small if dealt is None else dealt.unionByName(small)
        if done:
            return dealt
        rows = level.join(large, "fixed", "left_semi").drop("fixed")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character lies between ``a`` and ``b``, of which ``a`` is not longer."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


def near_in_group(fixed: str, words: list[str]) -> list[tuple[int, int]]:
    """Pairs (places of a shorter or equal word and of another) within one edit, which this group is the first to see."""
    m, lo, hi, marks = fixed.split("|")[:4]
    m, lo, hi = int(m), int(lo), int(hi)
    seen_before = [tuple(map(int, x.split(":"))) for x in marks.split(",") if x]
    index: dict[tuple[int, str, int], list[int]] = {}
    out = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):  # the shorter ones are indexed first
        w = words[i]
        part = f"^{w[lo : len(w) - hi]}$"
        grams = [part[k : k + 2] for k in range(len(part) - 1)]
        at_least = max(len(grams) - 2, 0)  # one edit takes two grams of the longer word
        if len(w) == m:
            lists = [index.get((m, g, k), ()) for k, g in enumerate(grams)]
        else:
            lists = [index.get((m, g, p), ()) for k, g in enumerate(grams) for p in (k - 1, k)]
        if at_least:
            close = [j for j, run in itertools.groupby(heapq.merge(*filter(None, lists))) if sum(1 for _ in run) >= at_least]
        else:
            close = index.get((m, "", 0), ())
        for j in close:
            v = words[j]
            if one_edit(v, w) and not any(v[o : o + h] == w[o : o + h] for o, h in seen_before):
                out.append((j, i))
        if len(w) == m:
            index.setdefault((m, "", 0), []).append(i)
            for k, g in enumerate(grams):
                index.setdefault((m, g, k), []).append(i)
    return out


def near_pairs(scratch: Scratch, words: DataFrame, *, largest: int = 64) -> DataFrame:
    """(word, n, other, other_n): each pair of words within one edit once, from a table of distinct words."""
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = _groups(scratch, words, largest).repartition(partitions, "fixed").sortWithinPartitions("fixed", "word")

    def run(batches):
        fixed, words, ns = None, [], []

        def pairs():
            for a, b in near_in_group(fixed, words) if len(words) > 1 else ():
                out.append((words[a], ns[a], words[b], ns[b]))

        for pdf in batches:
            out = []
            for f, w, n in zip(pdf["fixed"], pdf["word"], pdf["n"]):
                if f != fixed:
                    pairs()
                    fixed, words, ns = f, [], []
                words.append(w)
                ns.append(n)
            yield pd.DataFrame(out, columns=["word", "n", "other", "other_n"])
        out = []
        pairs()
        yield pd.DataFrame(out, columns=["word", "n", "other", "other_n"])

    return groups.mapInPandas(run, "word string, n long, other string, other_n long")


def forms(words: DataFrame, pairs: DataFrame, *, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, the first of equal ones, where it is ``times`` as frequent."""
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    got = words.join(best, "word", "left")
    goes = -F.col("best.less") >= times * F.col("n")
    return got.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(goes, F.col("best.other")).alias("form"), F.when(goes, -F.col("best.less")).alias("form_n"))


def with_roots(scratch: Scratch, found: DataFrame) -> DataFrame:
    """``found`` with ``root``, the end of each word's chain of forms; chains are halved in every round, and end as frequencies rise."""
    links = scratch.save(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")))
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        longer = scratch.save(links.join(ahead, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(links)
        links = longer
        if links.where("moved").isEmpty():
            break
        links = scratch.save(longer.select("word", "to"))
        scratch.drop(longer)
    return found.join(links.select("word", "to"), "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_n: int = 3, slip: int = 97, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the corpus.

    ``n_near`` counts the words within one edit, ``form`` is the most frequent of them if at least ``times`` as frequent,
    else null, ``root`` the last of the chain of forms, the word itself without one.  Null and empty texts hold no words, very
    long ones are read whole, repeated rows count again, equal frequencies go by code points; an empty table or one without
    frequent words gives no rows; other columns play no part, whatever their names."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "variants")
    words = scratch.save(count_words(docs, key=key, text=text, least_chars=least_chars, least_n=least_n, slip=slip))
    pairs = near_pairs(scratch, words)
    found = scratch.save(forms(words, pairs, times=times))
    return with_roots(scratch, found).select("word", "form", "root", "n", "n_near", "form_n")
