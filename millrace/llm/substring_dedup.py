"""Repeated passages: every word under a window that an earlier document also has is removed.

A window is ``window`` consecutive words.  Comparing all windows would move one row per word, so windows are first
thinned without losing any: each is filed under its smallest half-window hash (its anchor), which equal windows share.
A first pass counts anchors in count-min sketches per partition, merged by cell; a second pass looks only at windows whose
anchor is estimated to occur twice or more.  An estimate is never too low, so none is lost.  The sketch has eight cells for
each anchor.  Up to ``2**max_bits`` cells its bitmaps are sent to all executors; larger ones are tables of cells, to which
the anchors of all documents are joined.

Windows in a row with one anchor form a chunk.  Equal chunks are grouped exactly, and a later document loses all of an
equal chunk.  Single windows are compared only between the first holders of chunks that differ and share an anchor.  The
chunks are written once; minima are pre-aggregated and written as well, so that they are joined to the chunks as plain
tables and Spark can split a passage that a third of all documents hold.

A chunk or window is known by its anchor's hash and its own, 128 bits together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch, Segments, mix64, word_hashes

#: Anchors up to which they are sent to all executors; beyond it they are shuffled.
BROADCAST_ANCHORS = 500_000

_ROWS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A3F6B))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def _chunks(words: list[bytes], window: int):
    """Anchor hash, first window and end of each chunk, and the segment hashes of the text; None if too short."""
    n = len(words) - window + 1
    if n < 1:
        return None
    seg, half = Segments(mix64(word_hashes(words))), window // 2
    at = np.arange(len(words) - half + 1)
    grams = seg.at(at, at + half)
    lowest = np.lib.stride_tricks.sliding_window_view(grams, window - half + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
    return grams[lowest[first]], first, np.append(first[1:], n), seg


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix64(anchors * m) >> np.uint64(64 - bits) for m in _ROWS]


def repeated_cells(docs: DataFrame, text: str, window: int, bits: int) -> list[np.ndarray]:
    """For each row of the sketch, a bitmap of the cells that count two or more; ``2**bits`` bits each."""
    low = min(bits, 16)

    def sketch(batches):
        found = []
        for pdf in batches:
            for t in pdf[text]:
                got = _chunks(_words(t), window)
                if got:
                    found.append(np.unique(got[0]))
        if not found:
            return
        anchors, counts = np.unique(np.concatenate(found), return_counts=True)
        rows = []
        for r, cells in enumerate(_cells(anchors, bits)):
            order = np.argsort(cells)
            cells, twice = cells[order], counts[order] > 1
            part = (cells >> np.uint64(low)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                each = (cells[a:b] & np.uint64((1 << low) - 1)).astype(np.uint16)
                rows.append((r, int(part[a]), np.concatenate([each, each[twice[a:b]]]).tobytes()))
        yield pd.DataFrame(rows, columns=["r", "part", "cells"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << low, np.uint32)
        for b in pdf["cells"]:
            total += np.bincount(np.frombuffer(b, np.uint16), minlength=1 << low).astype(np.uint32)
        return pd.DataFrame({"r": pdf["r"].iloc[:1], "part": pdf["part"].iloc[:1], "bits": [np.packbits(total > 1).tobytes()]})

    parts = docs.select(text).mapInPandas(sketch, "r int, part long, cells binary").groupBy("r", "part").applyInPandas(merge, "r int, part long, bits binary")
    maps = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in _ROWS]
    size = max(1, (1 << low) // 8)
    for row in parts.toLocalIterator():  # at most two bitmaps of 2**max_bits bits in all
        maps[row.r][row.part * size : (row.part + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return maps


def _anchors_likely(rows: DataFrame, window: int, bits: int, scratch: Scratch) -> DataFrame:
    """(id, f, likely): per text, the anchors that both rows of the sketch count twice or more, by joins on cells."""

    def listed(batches):
        for pdf in batches:
            ids, marks, found = [], [], []
            for i, f, t in zip(pdf["id"], pdf["f"], pdf["text"]):
                got = _chunks(_words(t), window)
                if got:
                    each = np.unique(got[0])
                    found.append(each)
                    ids += [i] * len(each)
                    marks += [f] * len(each)
            if found:
                every = np.concatenate(found)
                cells = _cells(every, bits)
                yield pd.DataFrame({"id": ids, "f": marks, "anchor": every.astype(np.int64), "c0": cells[0].astype(np.int64), "c1": cells[1].astype(np.int64)})

    kind = rows.schema["id"].dataType.simpleString()
    left = scratch.save(rows.mapInPandas(listed, f"id {kind}, f long, anchor long, c0 long, c1 long"))
    full = [scratch.save(left.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c)) for c in ("c0", "c1")]
    for c, cells in zip(("c0", "c1"), full):
        left = left.join(cells, c, "left_semi")
    return scratch.save(left.groupBy("id", "f").agg(F.collect_list("anchor").alias("likely")))


def covered(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 50, max_bits: int = 28) -> DataFrame:
    """(id, f, runs): per document with repeats, array of (start, n) runs of windows that a smaller key also has; f is the
    text's hash, which tells rows of one key apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("f"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = max(1, chars // 7 * 4 // window)
    bits = max(10, int(anchors * 8).bit_length())
    maps = None
    if bits <= max_bits:
        maps = spark.sparkContext.broadcast(repeated_cells(rows, "text", window, bits))  # two bitmaps of 2**max_bits bits at most
        likely_rows = rows.withColumn("likely", F.lit(None).cast("array<long>"))
    else:
        likely_rows = rows.join(_anchors_likely(rows, window, bits, scratch), ["id", "f"])

    def likely(batches):
        for pdf in batches:
            out = []
            for i, f, t, listed in zip(pdf["id"], pdf["f"], pdf["text"], pdf["likely"]):
                got = _chunks(_words(t), window)
                if not got:
                    continue
                hashes, first, stop, seg = got
                if maps is None:
                    ok = np.isin(hashes.astype(np.int64), listed)
                else:
                    ok = np.ones(len(hashes), bool)
                    for m, cells in zip(maps.value, _cells(hashes, bits)):
                        ok &= (m[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                if not ok.any():
                    continue
                whole = seg.at(first, stop + window - 1).astype(np.int64)
                at = np.arange(stop[-1])
                each = seg.at(at, at + window)
                anchor = hashes.astype(np.int64)
                out += [(i, f, int(anchor[c]), int(whole[c]), int(first[c]), int(stop[c] - first[c]), each[first[c] : stop[c]].tobytes()) for c in np.flatnonzero(ok)]
            if out:
                yield pd.DataFrame(out, columns=["id", "f", "anchor", "chunk", "start", "n", "windows"])

    def windows(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy()
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({
                "id": np.repeat(pdf["id"].to_numpy(), n), "f": np.repeat(pdf["f"].to_numpy(), n), "anchor": np.repeat(pdf["anchor"].to_numpy(), n),
                "start": (np.repeat(pdf["start"].to_numpy(), n) + step).astype(np.int32),
                "w": np.concatenate([np.frombuffer(b, np.int64) for b in pdf["windows"]]) if len(pdf) else np.empty(0, np.int64),
            })

    chunks = likely_rows.select("id", "f", "text", "likely").mapInPandas(likely, f"id {kind}, f long, anchor long, chunk long, start int, n int, windows binary")
    chunks = scratch.save(chunks)
    lowest = scratch.save(chunks.groupBy("anchor", "chunk").agg(F.min("id").alias("m"), F.max("id").alias("x")))
    shared = scratch.save(lowest.where("m < x").select("anchor", "chunk", "m"))
    later = chunks.select("id", "f", "anchor", "chunk", "start", "n").join(shared, ["anchor", "chunk"]).where("id > m").select("id", "f", "start", "n")
    # anchors of chunks that differ, and their first holders
    mixed = scratch.save(lowest.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    some = chunks.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ANCHORS else mixed, "anchor", "left_semi")
    holders = some.join(lowest.select("anchor", "chunk", F.col("m").alias("id")), ["anchor", "chunk", "id"], "left_semi")
    single = scratch.save(holders.select("id", "f", "anchor", "start", "n", "windows").mapInPandas(windows, f"id {kind}, f long, anchor long, start int, w long"))
    again = scratch.save(single.groupBy("anchor", "w").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select("anchor", "w", "m"))
    first = single.join(again, ["anchor", "w"]).where("id > m").select("id", "f", "start", F.lit(1).alias("n"))
    return later.union(first).groupBy("id", "f").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 50, max_bits: int = 28) -> DataFrame:
    """(key, n_words, n_removed, kept): words left in each document, joined by one space.

    ``key`` orders documents.  Rows that repeat a key are judged one by one against smaller keys, never against each other.
    Null and empty texts have no words; a null key keeps all its words and removes none elsewhere; texts shorter than a
    window are kept whole, longer ones are read whole.  An empty table gives no rows; other columns play no part.
    """
    runs = covered(docs, key=key, text=text, window=window, max_bits=max_bits)
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("f"), F.col(text).alias("text"))
    rows = rows.join(runs.hint("shuffle_hash"), ["id", "f"], "left").select("id", "text", "runs")

    def cut(batches):
        for pdf in batches:
            out = []
            for i, t, found in zip(pdf["id"], pdf["text"], pdf["runs"]):
                words = _words(t)
                gone = 0
                if found is not None and len(found):
                    edge = np.zeros(len(words) + 1, np.int64)
                    a = np.array([r["start"] for r in found])
                    b = a + np.array([r["n"] for r in found]) + window - 1
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = int((~keep).sum())
                    kept = b" ".join([w for w, k in zip(words, keep) if k])
                else:
                    kept = b" ".join(words)
                out.append((i, len(words), gone, kept.decode()))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    left = rows.mapInPandas(cut, f"id {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return left.withColumnRenamed("id", key)


def sql(window: int = 50) -> str:
    """DuckDB SQL for ``dedup`` of the documents table, with the digest of the kept words."""
    return f"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
v as (select doc_id, unnest(range(1, len(ws) - {window - 2})) as i, unnest(list_transform(range(1, len(ws) - {window - 2}),
    lambda i: md5(array_to_string(ws[i:i + {window - 1}], ' ')))) as h from w where len(ws) >= {window}),
f as (select h, min(doc_id) as first from v group by h),
gone as (select distinct doc_id, unnest(range(i, i + {window})) as pos from v join f using (h) where first < doc_id),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as t from words anti join gone using (doc_id, pos) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from w left join kept k using (doc_id)
"""
