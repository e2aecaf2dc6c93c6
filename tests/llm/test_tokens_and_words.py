"""Tokenizer alignment, token counts and spelling variants against the libraries and brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, token_counts, variants
from millrace.llm.shared import Scratch

BITS = ["the ", "a", " ", "  ", "\n", "\t ", "tion", "été", "漢字", "▁", "<s>", "<|endoftext|>", "\x00", "ß!", "..", "12", " ", "　x", "😀", "é", "\x1c ", "\r\n", "----", "HELLO"]
ODD = [None, "", " ", "   ", "\n", "x " * 3000, "y" * 5000, " lead", "trail ", "a\n  b", "▁", "<0x41>"]
SCHEMA = "doc_id long, text string, part string, slot string, n string, word string, counts string"


@pytest.fixture(scope="module")
def byte_bpe():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(60))) for _ in range(300)] + ODD + ["the cat sat"] * 3


def table(spark, texts):
    return spark.createDataFrame([(i, t, "p", "s", "n", "w", "c") for i, t in enumerate(texts)], SCHEMA)


def spans(parts):
    ends = list(itertools.accumulate(map(len, parts)))
    return list(zip([0, *ends], ends))


def aligned(text, byte_bpe, pieces):
    """Ids, links and groups of one text by comparing all spans in order; nothing if the bytes do not come back."""
    if not text:
        return [], [], [], []
    char = {c: bytes([b]) for c, b in alignment._byte_of().items()}
    a, b = byte_bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    of_a = [b"".join(char[c] for c in byte_bpe.id_to_token(i)) for i in a]
    of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return [], [], [], []
    sa, sb, links, k = spans(of_a), spans(of_b), [], 0
    for i, (x, y) in enumerate(sa):
        while sb[k][1] <= x:
            k += 1
        links += [(a[i], b[j]) for j in itertools.takewhile(lambda j: j < len(sb) and sb[j][0] < y, itertools.count(k))]  # noqa: B023
    cuts = sorted({y for _, y in sa} & {y for _, y in sb})
    side = lambda ids, s, lo, hi: ",".join(str(i) for i, (_, y) in zip(ids, s) if lo < y <= hi)
    return a, b, links, [side(a, sa, lo, hi) + "|" + side(b, sb, lo, hi) for lo, hi in zip([0, *cuts], cuts)]


def expected_alignment(rows, byte_bpe, pieces):
    found = [(k, *aligned(t, byte_bpe, pieces)) for k, t in rows]
    count = Counter(x for *_, links, _ in found for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for k, a, b, links, groups in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((k, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str), {(b, a, n) for (a, b), n in count.items() if n == best[b]}


def digests(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_alignment(spark, texts, byte_bpe, pieces):
    docs = table(spark, texts)
    want, partners = expected_alignment(list(enumerate(texts)), byte_bpe, pieces)
    assert digests(alignment.align(docs)) == want
    assert sum(x[1] > 0 for x in want) > 80
    assert {(r.b, r.a, r["count"]) for r in alignment.best_partners(docs).collect()} == partners


def test_alignment_in_small_rows_and_many_tasks(spark, texts, byte_bpe, pieces, monkeypatch):
    """Rows of few links, several tasks for a stripe, and parts forgotten in between, give the same."""
    docs = table(spark, texts).repartition(3)
    want, _ = expected_alignment(list(enumerate(texts)), byte_bpe, pieces)
    monkeypatch.setattr(alignment, "_TASK", 50)
    assert digests(alignment.align(docs)) == want


def test_alignment_of_repeated_and_no_rows(spark, byte_bpe, pieces):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a")]
    want, _ = expected_alignment(rows, byte_bpe, pieces)
    assert digests(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert alignment.align(table(spark, [])).collect() == []
    assert digests(alignment.align(table(spark, [None, ""]))) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_link_rows_keep_large_counts():
    rows = alignment._Rows(50257)
    rows.add(np.full(1000, 7 * 50257 + 3), 5)
    rows.add(np.array([7 * 50257 + 3, 263 * 50257 + 1]), 9)
    (stripe, pairs, totals, docs, slots, times, links), = rows.flush()
    assert (stripe, links) == (7, 1002)
    assert np.frombuffer(totals, np.int64).tolist() == [1001, 1]
    assert np.frombuffer(pairs, np.uint32).tolist() == [3, 50257 + 1]
    at = np.cumsum(np.frombuffer(slots, np.uint16), dtype=np.uint16)
    assert [int(np.frombuffer(times, np.uint8)[at == s].sum(dtype=int)) for s in (5, 9)] == [1000, 2]
    assert np.frombuffer(docs, np.uint32).tolist() == [5, 1]


def test_token_counts(spark, texts, pieces):
    docs = table(spark, [*texts, "tion " * 9000])
    for r in token_counts.count(docs, limit=40).collect():
        t = [*texts, "tion " * 9000][r.doc_id] or ""
        fits = [k for k in range(min(len(t), 400) + 1) if len(pieces.encode(t[:k])) <= 40]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(pieces.encode(t)))
        if len(t) <= 400 or fits[-1] < 400:
            assert r.cut_chars == fits[-1]
    assert token_counts.count(table(spark, [])).collect() == []


def test_a_cut_needs_the_table_of_one_word(texts, pieces, monkeypatch):
    c, made = token_counts.PrefixCounter(token_counts.MODEL), []
    tables = c.tables
    monkeypatch.setattr(c, "tables", lambda words: made.extend(words) or tables(words))
    for t in [t for t in texts if t and len(t) < 300]:
        words = c.words(t)
        c.learn([words])
        sizes = [len(pieces.encode(t[:k])) for k in range(len(t) + 1)]
        for limit in (0, 1, 5, 40):
            made.clear()
            assert c.cut(words, limit) == max(k for k, n in enumerate(sizes) if n <= limit)
            assert len(made) <= 1


def test_counts_of_all_prefixes(spark, texts, pieces):
    some = [t for t in texts if t is None or len(t) < 300]
    made = token_counts.prefix_table(table(spark, some)).persist()
    for r in made.collect():
        t = some[r.doc_id] or ""
        assert r.counts == [len(pieces.encode(t[:k])) for k in range(len(t) + 1)]
    for r in token_counts.cuts(made, 7).collect():
        t = some[r.doc_id] or ""
        k = max(k for k in range(len(t) + 1) if len(pieces.encode(t[:k])) <= 7)
        assert (r.text or "", r.n_tokens) == (t[:k], len(pieces.encode(t[:k])))
    asked = made.select("doc_id", token_counts.tokens_at(3).alias("n"), token_counts.tokens_at(F.lit(10_000)).alias("none")).collect()
    assert all(r.none is None and r.n == (len(pieces.encode(some[r.doc_id][:3])) if len(some[r.doc_id] or "") >= 3 else None) for r in asked)


def brute_words(rows):
    count = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    form, size = {}, {}
    for w in n:
        close = [v for v in n if v != w and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        size[w], form[w] = len(close), best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], size[w], n.get(form[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_variants(spark):
    rng = random.Random(4)
    bank = ["".join(rng.choice("abÄéÿx") for _ in range(rng.randint(3, 9))) for _ in range(160)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÏabc", "ÿéÄéÿé"]
    rows = [(i, " ".join(rng.choice(bank) for _ in range(150)) + rng.choice(["", "÷×", "漢字abcde", "1a2"])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "ABCDEabcde " * 4), (502, "abcdeabcde " * 4), (None, "abcdeabcde zzzzz"), (503, "y" * 400 + " " + ("y" * 399 + " ") * 7)]
    docs = spark.createDataFrame([(i, t, "w", "n") for i, t in rows], "doc_id long, text string, word string, n string").repartition(5)
    n = brute_words(rows)
    assert len(n) > 100 and {r.word: r.n for r in variants.count_words(docs).collect()} == n
    assert rows_of(variants.group(docs)) == brute_groups(n)
    assert variants.group(docs.limit(0)).collect() == []


def test_variants_with_tasks_that_hold_no_words(spark, tmp_path):
    """Some tasks read null and empty texts alone, or a part of a file in which no row group begins."""
    rows = [(i, "abcdeabcde abcdeabcdf" if i < 4 else None if i < 8 else "1 2") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(variants.group(docs.repartitionByRange(15, "doc_id"))) == brute_groups(brute_words(rows))
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        read = spark.read.parquet(str(tmp_path / "docs"))
        assert read.rdd.getNumPartitions() > 1 and rows_of(variants.group(read)) == brute_groups(brute_words(rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


@pytest.mark.parametrize("largest", [1, 2, 8, 1000])
def test_pairs_are_found_once_whatever_the_groups(spark, largest):
    rng = random.Random(largest)
    bank = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(120)} | {"abcde" + c + d for c in "abcdefgh" for d in "abc"}
    words = spark.createDataFrame([(w, 3) for w in bank], "word string, n long")
    found = [tuple(sorted((r.word, r.other))) for r in variants.near_pairs(Scratch(spark, "test"), words, largest=largest).collect()]
    assert sorted(found) == sorted((a, b) for a, b in itertools.combinations(sorted(bank), 2) if near(a, b))
