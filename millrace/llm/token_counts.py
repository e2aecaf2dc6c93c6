"""Token counts of texts and of all their prefixes, by dynamic programming over the last token of each prefix.

The byte-pair encoding of a prefix is the encoding of a shorter prefix and one more token, and a token may follow another
exactly if the two are the encoding of their own concatenation.  So the last token of every prefix follows from those before
it, and with it the exact count, although the encoding of a prefix need not be a prefix of the encoding.  No piece of the
vocabulary goes from another character into a space, so the table is computed for a word with the spaces before it and put
together for a text.  Questions on truncation and budgets are then lookups: nothing is encoded again.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Words and pairs of tokens remembered by a worker, a bound of its memory alone.
_REMEMBERED = 800_000


class PrefixCounter:
    """Counts of all prefixes under one sentencepiece model; what it remembers does not change a result."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        other = (self.model.is_control, self.model.is_unknown, self.model.is_byte, self.model.is_unused)
        self.ids = {self.model.id_to_piece(i): i for i in range(self.model.get_piece_size()) if not any(is_so(i) for is_so in other)}
        self.ends: dict = {}  # pieces by their characters from the last to the first; at "" the piece itself
        for p in self.ids:
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        known = set().union(*self.ids)
        self.anchor = next(c for c in "\n\t" if c not in known)  # merges with nothing, so what follows is encoded by itself
        self.skip = len(self.model.encode(self.anchor))
        self.totals: dict[str, int] = {}
        self.follows: dict[tuple[str | None, str], bool] = {}

    def encode(self, s: str) -> list[int]:
        """Ids of ``s`` without the space that the library puts before a text."""
        return self.model.encode(self.anchor + s)[self.skip :]

    def _may_follow(self, before: str | None, piece: str) -> bool:
        ids = [self.ids[piece]] if before is None else [self.ids[before], self.ids[piece]]
        if len(self.follows) > 2 * _REMEMBERED:
            self.follows.clear()
        found = self.follows[before, piece] = self.encode((before or "") + piece) == ids
        return found

    def _extend(self, s: str, counts: list[int], last: list[str | None]) -> None:
        """Add the prefixes of ``s`` that are longer than those in ``counts`` and ``last``, its tokens and last tokens so far."""
        ends, ids, follows = self.ends, self.ids, self.follows
        for p in range(len(counts), len(s) + 1):
            c = s[p - 1]
            if c not in ids:  # a character that is no piece stands for itself, as bytes
                counts.append(counts[-1] + len(c.encode()))
                last.append(None)
                continue
            node, at = ends[c], p - 1
            while True:
                if "" in node:
                    link = (last[at], node[""])
                    if (good := follows.get(link)) is None:
                        good = self._may_follow(*link)
                    if good:
                        counts.append(counts[at] + 1)
                        last.append(link[1])
                        break
                at -= 1
                if at < 0 or (node := node.get(s[at])) is None:
                    raise ValueError(f"no last token for {s[:p]!r}: the model is no byte-pair encoding")

    def tables(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each of the sorted words with the counts of its prefixes of 0, 1, 2, ... code points; words share those of a common prefix.
        The list is good until the next word."""
        before, counts, last = "", [0], [None]
        for w in words:
            n, most = 0, min(len(w), len(before))
            while n < most and w[n] == before[n]:
                n += 1
            del counts[n + 1 :], last[n + 1 :]
            self._extend(w, counts, last)
            before = w
            yield w, counts

    def words(self, text: str) -> list[str]:
        """The parts of a text that are encoded by themselves."""
        if not text:
            return []
        if not self.by_word:
            return [SPACE + text.replace(" ", SPACE)]
        if text[0] in " ▁" or "  " in text or SPACE in text:
            return _WORD.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")

    def learn(self, texts: list[list[str]]) -> None:
        """Find the counts of the words of these texts that are not known yet."""
        if len(self.totals) > _REMEMBERED:
            self.totals.clear()
        for w, counts in self.tables(sorted(w for w in set().union(*texts) if w not in self.totals)):
            self.totals[w] = counts[-1]

    def total(self, words: list[str]) -> int:
        return sum(map(self.totals.__getitem__, words))

    def cut(self, words: list[str], limit: int) -> int:
        """Code points of the longest prefix of a text of at most ``limit`` tokens.  Every prefix of a word has a token at least and
        the words before it have theirs whole, so the cut lies in the last word that such a prefix can reach, or before it."""
        ahead = [0, *itertools.accumulate(map(self.totals.__getitem__, words))]
        k = min(bisect.bisect_left(ahead, limit), len(words)) - 1  # the last word with less than the limit before it
        if k < 0:
            return 0
        ((_, counts),) = self.tables(words[k : k + 1])
        inside = max(i for i, n in enumerate(counts) if ahead[k] + n <= limit)  # counts may fall where a longer token fits
        return max(0, sum(map(len, words[:k])) + inside - 1)  # without the added space

    def prefixes(self, words: list[str]) -> np.ndarray:
        """Count of every prefix of a text, from that of no code point to the whole."""
        found = {w: np.array(counts[1:], np.int32) for w, counts in self.tables(sorted(set(words)))}
        out, base = [np.zeros(1, np.int32)], 0
        for w in words:
            out.append(found[w] + np.int32(base))
            base += int(found[w][-1])
        counts = np.concatenate(out)
        return np.concatenate([counts[:1], counts[2:]])  # without the prefix that is only the added space


def sliced(texts: list[str], chars: int = 6_000_000) -> Iterator[list[str]]:
    """The texts in runs of about so many characters, so that their words are held for a while only."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = 4096, model: str = MODEL) -> DataFrame:
    """(key, n_bytes, n_tokens, cut_chars): UTF-8 bytes and tokens of the whole text, and the code points of its longest
    prefix of at most ``limit`` tokens, all from the prefix counts of words; a cut asks for those of one word.

    Rows are counted one by one: null and empty texts have 0 of each, repeated rows equal figures, null keys stay; an empty
    table gives none; other columns play no part, whatever their names.  Work and memory are linear in the text."""
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "cut_chars"))])

    def run(batches):
        c = counter(model)
        for pdf in batches:
            out = []
            for texts in sliced([t or "" for t in pdf[text]]):
                split = [c.words(t) for t in texts]
                c.learn(split)
                for t, words in zip(texts, split):
                    n = c.total(words)
                    out.append((len(t.encode()), n, len(t) if n <= limit else c.cut(words, limit)))
            got = pd.DataFrame(out, columns=["n_bytes", "n_tokens", "cut_chars"], dtype="int64")
            got.insert(0, key, pdf[key].to_numpy())
            yield got

    return docs.select(key, text).mapInPandas(run, schema)


def prefix_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, text, counts array<int>): ``counts[k]`` is the exact number of tokens of the first k code points.

    To be written once and asked by ``tokens_at``, ``cut_at`` and ``cuts``; null and empty texts have the array of one 0."""
    schema = T.StructType([docs.schema[key], T.StructField(text, T.StringType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = counter(model)
        for pdf in batches:
            yield pdf.assign(counts=[c.prefixes(c.words(t or "")) if t else np.zeros(1, np.int32) for t in pdf[text]])

    return docs.select(key, text).mapInPandas(run, schema)


def tokens_at(chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first ``chars`` code points; null beyond the text."""
    return F.try_element_at(counts, (F.lit(chars) if isinstance(chars, int) else chars).cast("int") + 1)


def cut_at(limit: Column | int, counts: str = "counts") -> Column:
    """Code points of the longest prefix of at most ``limit`` tokens."""
    return (F.array_max(F.filter(F.transform(counts, lambda n, k: F.when(n <= limit, k)), lambda k: k.isNotNull()))).cast("long")


def cuts(table: DataFrame, limit: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_tokens) with every text cut to its longest prefix of at most ``limit`` tokens, by lookups alone."""
    at = table.withColumn("counts_cut", cut_at(limit))
    return at.select(key, F.substring(text, F.lit(1), F.col("counts_cut").cast("int")).alias(text), tokens_at(F.col("counts_cut")).cast("long").alias("n_tokens"))
