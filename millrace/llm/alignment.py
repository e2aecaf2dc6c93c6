"""Alignment of two tokenizers over a corpus: which token ids stand for the same bytes, how often, and how well a document's links agree.

Two tokenizations of the same bytes are laid over each other.  Between neighbouring ends of any token lies a piece that
exactly one token of either side covers: a link.  How often the corpus links two ids is counted in dense matrices, striped by
the id of the second side: pairs go to their id's stripe and are added into its block, whose row maxima tell each id's best
partner.  The links of documents are dealt out like the stripes, so that each block scores the links that came to it.

Both tokenizers begin anew where a space follows another character, so texts are put together from such parts, each of
which is encoded once per batch of texts.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import Scratch, shuffle_partitions

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
#: Stripes of the count matrix, and groups of stripes that a task scores one after another.
STRIPES, GROUPS = 256, 16
#: Links that are gathered in one row, and links that one task scores.
_ROW, _TASK = 2_000_000, 8_000_000
_REMEMBERED = 300_000
_BREAK = re.compile(r"(?<=\S)(?= )")
_UNCLEAR = re.compile(r"\s ")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of byte-level vocabularies stand for: printable ones themselves, others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Links between two tokenizations; what it remembers of earlier texts does not change a result."""

    def __init__(self, a: str, b: str):
        with open(a, encoding="utf-8") as f:
            made = json.load(f)
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in made["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        order = [made["model"]["vocab"][x + y] for x, y in merges]
        if order != sorted(order):
            raise ValueError(f"{a}: merges must be in the order of their ids")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_a = max(ranks.values()) + 1
        a_bytes = {i: token for token, i in ranks.items()}
        self.a_size = np.array([len(a_bytes.get(i, b"")) for i in range(self.n_a)], np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{b}: pieces must not go on from another character into a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.before = self.b.encode("\n")  # a line break merges with nothing, so what follows is encoded by itself
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # as _COUNTS
        self.sound = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)  # where each part's links begin
        self.links = np.zeros(0, np.int64)  # id of b times ids of a, plus id of a

    def parts(self, text: str) -> Iterator[list[str]]:
        """Parts of the text without the space each begins with; a long text comes in several lists."""
        s = " " + text
        if not _UNCLEAR.search(s):
            for k in range(0, len(text) + 1, step := 4_000_000):  # a slice ends within a part, which goes to the next list
                part = text[k : k + step].split(" ")
                rest = part if k == 0 else [rest[-1] + part[0], *part[1:]]  # noqa: F821
                yield rest if k + step > len(text) else rest[:-1]
        else:
            yield [p[1:] for p in _BREAK.split(s)]

    def learn(self, words: set[str]) -> None:
        """Encode and align the parts that are not known yet."""
        new = sorted(w for w in words if w not in self.place)
        if not new:
            return
        plain = [w for w in new if w and w.split() == [w]]  # these are encoded in a row, each begins with a space
        odd = sorted(set(new) - set(plain))
        new = plain + odd
        size = np.array([1 + len(w.encode()) for w in new], np.int64)
        ends = np.cumsum(size)
        ids_a = self.a.encode_ordinary(" " + " ".join(plain)) if plain else []
        for w in odd:
            ids_a += self.a.encode_ordinary(" " + w)
        skip = len(self.before)
        of_b = [ids[skip:] for ids in self.b.encode(["\n " + w for w in new], num_threads=1)]
        good = np.array([b"".join(map(self.b_bytes.__getitem__, ids)) == b" " + w.encode() for ids, w in zip(of_b, new)], bool)
        if not good.all():  # parts whose bytes do not come back have no tokens
            kept = np.flatnonzero(good)
            a_end = np.cumsum(self.a_size[ids_a])
            part_of = np.searchsorted(ends, a_end)
            ids_a = np.array(ids_a, np.int64)[good[part_of]].tolist()
            of_b = [ids if ok else [] for ids, ok in zip(of_b, good)]
        else:
            kept = np.arange(len(new))
        ids_a, ids_b = np.array(ids_a, np.int64), np.fromiter(itertools.chain.from_iterable(of_b), np.int64)
        end_a, end_b, ends = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b]), np.cumsum(size[kept])
        cuts = np.union1d(end_a, end_b)  # between two cuts lies one link
        link_a, link_b = ids_a[np.searchsorted(end_a, cuts)], ids_b[np.searchsorted(end_b, cuts)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)  # where a group ends
        counts = np.zeros((len(new), 4), np.int64)
        upto = [np.searchsorted(x, ends, "right") for x in (end_a, end_b, both, cuts)]
        for k, u in enumerate(upto):
            counts[kept, k] = np.diff(u, prepend=0)
        name_a, name_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        to_a, to_b = np.searchsorted(end_a, both, "right").tolist(), np.searchsorted(end_b, both, "right").tolist()
        groups = [",".join(name_a[i:j]) + "|" + ",".join(name_b[k:m]) for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        shown = [""] * len(new)
        for n, i, j in zip(kept.tolist(), [0, *upto[2].tolist()], upto[2].tolist()):
            shown[n] = ";".join(groups[i:j])
        start = len(self.groups)
        self.place.update(zip(new, range(start, start + len(new))))
        self.groups += shown
        self.counts = np.concatenate([self.counts, counts])
        self.sound = np.concatenate([self.sound, good])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts[:, 3])])
        self.links = np.concatenate([self.links, link_b * self.n_a + link_a])

    def find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def links_of(self, found: np.ndarray) -> np.ndarray:
        n = self.counts[found, 3]
        return self.links[np.repeat(self.first[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]


@functools.cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


class _Rows:
    """Links of documents on their way to the stripes: one row for each stripe and about ``_ROW`` links.

    A row holds its distinct pairs as places in the stripe's block (``pairs``), the links of each (``totals``), and the
    documents of each pair: their number (``docs``), their slots as differences (``slots``) and their links (``times``)."""

    def __init__(self, n_a: int):
        self.n_a, self.codes, self.slots, self.n = n_a, [], [], 0

    def add(self, codes: np.ndarray, slot: int) -> None:
        self.codes.append(codes)
        self.slots.append(np.full(len(codes), slot, np.int64))
        self.n += len(codes)

    def flush(self) -> list[tuple]:
        if not self.n:
            return []
        codes, slots = np.concatenate(self.codes), np.concatenate(self.slots)
        self.codes, self.slots, self.n = [], [], 0
        b, a = np.divmod(codes, self.n_a)
        block = -(-(1 << 20) // STRIPES) * self.n_a  # cells of a stripe, for ids below 2^20
        key, times = np.unique(((b % STRIPES) * block + (b // STRIPES) * self.n_a + a) << 16 | slots, return_counts=True)
        over = times > 255  # counts are bytes: larger ones come in several entries
        if over.any():
            again = np.maximum(1, -(-times // 255))
            last = np.cumsum(again) - 1
            spread = np.full(again.sum(), 255, np.int64)
            spread[last] = times - 255 * (again - 1)
            key, times = np.repeat(key, again), spread
        pair, slot = key >> 16, (key & 0xFFFF).astype(np.uint16)
        begins = np.flatnonzero(np.diff(pair, prepend=-1))
        docs, totals = np.diff(np.append(begins, len(pair))), np.add.reduceat(times, begins)
        stripe, cell = np.divmod(pair[begins], block)
        out = []
        edges = np.append(np.flatnonzero(np.diff(stripe, prepend=-1)), len(stripe))
        for i, j in itertools.pairwise(edges.tolist()):
            x, y = begins[i], begins[j] if j < len(begins) else len(pair)
            out.append((
                int(stripe[i]), cell[i:j].astype(np.uint32).tobytes(), totals[i:j].tobytes(), docs[i:j].astype(np.uint32).tobytes(),
                np.diff(slot[x:y], prepend=np.uint16(0)).tobytes(), times[x:y].astype(np.uint8).tobytes(), int(totals[i:j].sum()),
            ))
        return out


def _aligned(docs: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """A row for each document and the rows of links, told apart by ``stripe``; (part, slot) is the document's place."""
    blobs = ("pairs", "totals", "docs", "slots", "times")
    schema = T.StructType([
        docs.schema[key], T.StructField("part", T.LongType()), T.StructField("slot", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("groups_sha256", T.StringType()), T.StructField("stripe", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in blobs), T.StructField("links", T.LongType()),
    ])

    def run(batches):
        al = aligner(a, b)
        part = TaskContext.get().partitionId() << 32
        for pdf in batches:
            keys, texts = pdf[key].to_numpy(), [t or "" for t in pdf[text]]
            start = 0
            while start < len(texts):
                if len(al.place) > _REMEMBERED or len(al.links) > 4 * _ROW:
                    al.forget()
                stop, held = start, 0
                while stop < len(texts) and stop - start < 60_000 and (held == 0 or held + len(texts[stop]) <= 4_000_000):
                    held += len(texts[stop])
                    stop += 1
                rows, seen, sent = _Rows(al.n_a), [], []
                split = [[words for words in al.parts(t) if words] if t else [] for t in texts[start:stop]]
                al.learn(set().union(*(words for lists in split for words in lists)))
                for slot, lists in enumerate(split):
                    found = [al.find(words) for words in lists]
                    if not found or not all(al.sound[f].all() for f in found):
                        seen.append((0, 0, 0, 0, ""))
                        continue
                    sha = hashlib.sha256()
                    for i, words in enumerate(lists):
                        sha.update(((";" if i else "") + ";".join(map(al.groups.__getitem__, found[i].tolist()))).encode())
                    seen.append((*sum(al.counts[f].sum(axis=0) for f in found).tolist(), sha.hexdigest()))
                    for f in found:
                        for k in range(0, len(f), 200_000):
                            rows.add(al.links_of(f[k : k + 200_000]), slot)
                            if rows.n >= _ROW:
                                sent += rows.flush()
                sent += rows.flush()
                own = pd.DataFrame(seen, columns=[*_COUNTS, "groups_sha256"])
                own.insert(0, key, pd.Series(keys[start:stop], dtype=object))
                own["slot"] = np.arange(len(own))
                links = pd.DataFrame(sent, columns=["stripe", *blobs, "links"])
                out = pd.concat([own, links]).assign(part=part)[[f.name for f in schema]]
                yield out.astype({c: "Int64" for c in ("slot", *_COUNTS, "stripe", "links")})
                part += 1
                start = stop

    return docs.select(key, text).mapInPandas(run, schema)


_BLOCK = "stripe int, pairs binary, totals binary"


def _block(n_a: int, rows: int) -> np.ndarray:
    return np.zeros(rows * n_a, np.int64)


def _add_up(n_a: int, n_rows: int):
    """Adds rows of (stripe, pairs, totals), sorted by stripe, into the stripe's dense block and yields the cells that are not 0."""

    def run(batches):
        at, block = None, None
        for pdf in batches:
            out = []
            for stripe, pairs, totals in zip(pdf["stripe"], pdf["pairs"], pdf["totals"]):
                if stripe != at:
                    if at is not None:
                        out.append((at, *_cells(block)))
                    at, block = stripe, _block(n_a, n_rows)
                np.add.at(block, np.frombuffer(pairs, np.uint32), np.frombuffer(totals, np.int64))
            yield pd.DataFrame(out, columns=["stripe", "pairs", "totals"])
        if at is not None:
            yield pd.DataFrame([(at, *_cells(block))], columns=["stripe", "pairs", "totals"])

    return run


def _cells(block: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(block)
    return at.astype(np.uint32).tobytes(), block[at].tobytes()


def _count(links: DataFrame, n_a: int, n_rows: int, partitions: int) -> DataFrame:
    """(stripe, pairs, totals): the count matrix. Beyond some rows a stripe, they are first added up in several tasks a stripe."""
    rows = links.select("stripe", "pairs", "totals", "part")
    tasks = links.count() // (STRIPES * 400) + 1  # a stripe has at most one row for each row of links
    if tasks > 1:
        dealt = rows.repartition(partitions, "stripe", F.pmod(F.hash("part"), F.lit(tasks))).sortWithinPartitions("stripe")
        rows = dealt.select("stripe", "pairs", "totals").mapInPandas(_add_up(n_a, n_rows), _BLOCK)
    else:
        rows = rows.drop("part")
    return rows.repartition(partitions, "stripe").sortWithinPartitions("stripe").mapInPandas(_add_up(n_a, n_rows), _BLOCK)


def _score(links: DataFrame, counts: DataFrame, n_a: int, n_rows: int, partitions: int) -> DataFrame:
    """(part, slot, n_best, count_sum), to be summed up: links meet the block of their stripe, which scores them.

    A group of stripes with many links is scored by several tasks, each with its own copy of the blocks; which documents go
    to which is told by their part."""
    many = {r.g: r.n for r in links.groupBy((F.col("stripe") % GROUPS).alias("g")).agg(F.sum("links").alias("n")).collect()}  # GROUPS rows
    copies = F.element_at(F.array(*[F.lit(many.get(g, 0) // _TASK + 1) for g in range(GROUPS)]), F.col("stripe") % GROUPS + 1)
    empty = F.lit(None).cast("binary")
    blocks = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), "pairs", "totals", empty.alias("docs"), empty.alias("slots"), empty.alias("times"))
    asked = links.select("stripe", F.pmod(F.hash("part").cast("long"), copies).alias("copy"), F.lit(1).alias("kind"), "part", "pairs", empty.alias("totals"), "docs", "slots", "times")
    dealt = blocks.union(asked).repartition(partitions, F.col("stripe") % GROUPS, "copy").sortWithinPartitions("copy", "stripe", "kind", "part")

    def run(batches):
        block = best = None
        sums: dict[int, np.ndarray] = {}

        def done():
            for part, s in sums.items():
                slot = np.flatnonzero(s[1])
                yield pd.DataFrame({"part": part, "slot": slot, "n_best": s[0][slot], "count_sum": s[1][slot]})
            sums.clear()

        for pdf in batches:
            for kind, part, pairs, totals, docs, slots, times in zip(*(pdf[c] for c in ("kind", "part", "pairs", "totals", "docs", "slots", "times"))):
                cells = np.frombuffer(pairs, np.uint32)
                if kind == 0:
                    block = _block(n_a, n_rows)
                    np.add.at(block, cells, np.frombuffer(totals, np.int64))
                    best = block.reshape(n_rows, n_a).max(axis=1)
                    continue
                n = block[cells]
                docs = np.frombuffer(docs, np.uint32)
                slots = np.cumsum(np.frombuffer(slots, np.uint16), dtype=np.uint16)
                times = np.frombuffer(times, np.uint8).astype(np.int64)
                if (s := sums.get(part)) is None or s.shape[1] <= slots.max():
                    more = np.zeros((2, int(slots.max()) + 1), np.int64)
                    if s is not None:
                        more[:, : s.shape[1]] += s
                    s = sums[part] = more
                np.add.at(s[0], slots, np.repeat((n == best[cells // n_a]).astype(np.int64), docs) * times)
                np.add.at(s[1], slots, np.repeat(n, docs) * times)
            if len(sums) > 500:
                yield from done()
        yield from done()

    return dealt.drop("copy").mapInPandas(run, "part long, slot int, n_best long, count_sum long")


def align(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a: str = A, b: str = B) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``a`` is a byte-level vocabulary, ``b`` a sentencepiece model; both read the text after one space.  Null and empty texts
    and those whose tokens do not give back their bytes have no tokens: zeros and an empty string, and they add to no count.
    Rows are kept apart, so repeated ids count again and keep a row each, as do null keys; ties for the best are all best; an
    empty table gives none; other columns play no part, whatever their names.  Long texts are taken whole, in pieces."""
    spark = docs.sparkSession
    al, partitions = aligner(a, b), shuffle_partitions(spark)
    n_a, n_rows = al.n_a, -(-al.n_b // STRIPES)
    scratch = Scratch(spark, "alignment")
    made = scratch.save(_aligned(docs, key, text, a, b))
    own = made.where(F.col("stripe").isNull()).select(key, "part", "slot", *_COUNTS, "groups_sha256")
    links = made.where(F.col("stripe").isNotNull())
    counts = scratch.save(_count(links, n_a, n_rows, partitions))
    scores = _score(links, counts, n_a, n_rows, partitions).groupBy("part", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(scores, ["part", "slot"], "left").select(key, *_COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")


def best_partners(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a: str = A, b: str = B) -> DataFrame:
    """(b, a, count): for every id of the second tokenizer the ids of the first that the corpus links to it most often, ties included."""
    spark = docs.sparkSession
    al, scratch = aligner(a, b), Scratch(spark, "alignment")
    n_a, n_rows = al.n_a, -(-al.n_b // STRIPES)
    links = scratch.save(_aligned(docs, key, text, a, b)).where(F.col("stripe").isNotNull())
    counts = _count(links, n_a, n_rows, shuffle_partitions(spark))

    def run(batches):
        for pdf in batches:
            for stripe, pairs, totals in zip(pdf["stripe"], pdf["pairs"], pdf["totals"]):
                cells, n = np.frombuffer(pairs, np.uint32).astype(np.int64), np.frombuffer(totals, np.int64)
                row, most = cells // n_a, np.zeros(n_rows, np.int64)
                np.maximum.at(most, row, n)
                top = n == most[row]
                yield pd.DataFrame({"b": row[top] * STRIPES + stripe, "a": cells[top] % n_a, "count": n[top]})

    return counts.mapInPandas(run, "b long, a long, count long")
