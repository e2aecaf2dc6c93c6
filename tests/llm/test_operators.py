"""Operators against brute-force versions on small tables, with nulls, empty texts, ties, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, embedding_dedup, html_extract, line_dedup, mixing, ngram_join, pii, quality, substring_dedup, toxicity
from millrace.llm.shared import Scratch, connected_components

DOCS = "doc_id long, text string, source string, component_id string, n string"


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty and long ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(70)]
    texts = [None, "", " \t\n", "one", "One  TWO", "a b c", "a b c"]
    base = [[word() for _ in range(n)] for n in (12, 40, 90, 200, 1500)]
    for b in base:
        for k in range(8):
            t = list(b)
            for _ in range(k // 2):
                t[rng.randrange(len(t))] = word()
            texts.append(rng.choice([" ", "\n"]).join(t))
    for k in range(6):
        texts.append(" ".join([word() for _ in range(20)] + passage[k:] + [word() for _ in range(10)]))
    rng.shuffle(texts)
    return texts


def table(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}", "x", "y") for i, t in enumerate(texts)], DOCS)


def words(t):
    return (t or "").encode().split()


def shingles(t, k):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def components(sets, linked):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if linked(sets[a], sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_join(spark, corpus, k, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(table(spark, corpus), k=k, num=num).collect()}
    sets = {i: shingles(t, k) for i, t in enumerate(corpus)}
    want = components(sets, lambda a, b: bool(a) and 100 * len(a & b) >= num * len(a | b))
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert any(i != c for i, c in want.items())


def test_ngram_join_hot_group(spark):
    """Hundreds of near copies in one group, some of them bridges between parts of it."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(60)] = f"v{rng.randrange(4)}"
        texts.append(" ".join(t))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(table(spark, texts)).collect()}
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    assert got == components(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))


def test_ngram_join_text_of_one_shingle(spark):
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(table(spark, ["a a a a", "a a a a a", "a a a"]), k=4, num=85).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_ngram_join_empty_and_null_keys(spark):
    assert ngram_join.similar_groups(table(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in ngram_join.similar_groups(df).collect())
    assert got == [(0, None), (1, 1), (1, 1)]


def test_ngram_join_repeated_ids(spark):
    """An id with several texts is one document, judged by one of them."""
    a, b = "a b c d e f", "p q r s t u v w"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, None), (4, a), (5, ""), (5, None)]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, token int, rep string")
    got = sorted({(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()})
    assert got in ([(1, 3, 1), (2, 3, 1), (3, 5, 3), (4, 3, 1), (5, 0, 5)], [(1, 5, 1), (2, 3, 2), (3, 5, 1), (4, 3, 2), (5, 0, 5)])


def test_ngram_join_hot_line_and_long_text(spark):
    """Thousands of short texts share one line, few are near copies; one text has two million characters."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(20))
    texts = [f"{line} {' '.join(word() for _ in range(rng.randint(0, 9)))}" for _ in range(3000)]
    texts += [f"{t} {word()}" for t in texts[:200]]
    long = " ".join(word() for _ in range(400_000))
    texts += [long, f"{word()} {long}"]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(table(spark, texts), k=5, num=80).collect()}
    sets = {i: shingles(t, 5) for i, t in enumerate(texts[:-2])}
    by_size = sorted(sets, key=lambda i: len(sets[i]))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, i in enumerate(by_size):
        for j in by_size[at + 1 :]:
            if 100 * len(sets[i]) < 80 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = {i: root(i) for i in sets}
    assert got == want | {3200: 3200, 3201: 3200}


def test_ngram_join_heads_share_enough():
    """The bound on what the heads of linked sets share, at the least similar pairs of all sizes."""
    for num, den in ((85, 100), (80, 100), (1, 1), (9, 10)):
        for n in range(1, 400):
            for m in range(n, n * den // num + 1):
                both = -(-num * (n + m) // (num + den))
                lost = max(ngram_join._rest(n, num, den), ngram_join._rest(m, num, den))
                if both <= n:
                    assert both - lost >= max(ngram_join._least(n, num, den), ngram_join._least(m, num, den))


def test_ngram_join_holds_few_texts_at_once():
    """A worker copies neither the texts it is sent nor the token lists of pairs, and hands its tokens on in small parts."""
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(2000)]
    sent = pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": texts})
    del texts
    tracemalloc.start()
    parts = [len(got) for got in ngram_join._heads(4, 85, 100)([sent])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(parts) == 2000 and max(parts) < 1000 and peak < sent.nbytes / 2
    sets = [[1, 2, 3, 4], [5, 6], [7], []]
    pairs = pa.RecordBatch.from_pydict({"a": [1, 2, 3, 4], "b": [5, 6, 7, 8], "na": [4, 2, 1, 0], "nb": [4, 2, 1, 0], "ta": sets, "tb": [[1, 2, 3, 4], [5, 7], [7], []]},
                                       pa.schema([(c, pa.int64()) for c in ("a", "b", "na", "nb")] + [(c, pa.list_(pa.int64())) for c in ("ta", "tb")]))
    assert [list(ngram_join._verify(85, 100)([pairs.slice(i, 2)]))[0]["a"].to_pylist() for i in (0, 1)] == [[1], [3]]


def test_substring_dedup(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(table(spark, corpus), window=50).collect()}
    first = {}
    for i, t in enumerate(corpus):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(corpus):
        w = words(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        assert got[i] == (len(w), len(gone), kept)
    assert any(n for _, n, _ in got.values())
    assert substring_dedup.dedup(table(spark, [])).count() == 0


def test_substring_dedup_without_broadcasts(spark, corpus, monkeypatch):
    """A sketch that is a table of cells gives the same result."""
    b = substring_dedup.dedup(table(spark, corpus), window=20).collect()
    monkeypatch.setattr(substring_dedup, "BROADCAST_ANCHORS", 0)
    a = substring_dedup.dedup(table(spark, corpus), window=20, max_bits=4).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_substring_dedup_odd_rows(spark):
    """Repeated keys, null keys, a long text and clashing names."""
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    p, long = say(60), say(200_000)
    rows = [(1, p), (1, say(5) + " " + p), (2, f"x {p} y"), (2, p), (2, p), (None, p), (3, long), (4, say(300) + " " + long), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "start long, f string, id int, anchor string")
    got = sorted((r.start or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs, key="start", text="f").collect())
    assert got == sorted([(1, 60, 0), (1, 65, 0), (2, 62, 60), (2, 60, 60), (2, 60, 60), (0, 60, 0), (3, 200_000, 0), (4, 200_300, 200_000), (5, 0, 0), (6, 0, 0)])


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base_kinds_match_plain_scan(spark):
    rng = random.Random(3)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "+1", "+49 30 1234567", "é", "12", " ", "-", ".", "a", "+", "b@c.d@e.f", "192.168.0.1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "4111111111111111 " * 500]
    got = {r.doc_id: r for r in pii.digest(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert got[i].n_email == sum(k == "email" for k, _, _ in want)


def test_pii_added_kinds_and_redaction(spark):
    t = "See https://a.example/x, account no: 12345678-AB; IBAN DE89370400440532013000, 12 Long Street."
    assert [(k, t[a:b]) for k, a, b in pii.spans(t)] == [("url", "https://a.example/x"), ("account", "12345678-AB"), ("account", "DE89370400440532013000"), ("street", "12 Long Street")]
    for text, values in (
        ('a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b', ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]),
        ("api_key: 'sk-Ab9/x+Q==' and PASSWORD=hunter2hunter3", ["sk-Ab9/x+Q==", "hunter2hunter3"]),
        ("the token was lost = nothing, secret = ordinary words, password: see below, tokens = 12", []),
    ):
        assert [text[a:b] for k, a, b in pii.spans(text) if k == "secret"] == values
    out = pii.redact(table(spark, [t, None, "mail me: a@b.cd"])).orderBy("doc_id").collect()
    assert out[0].redacted == "See [url], account no: [account]; IBAN [account], [street]."
    assert out[1].redacted is None and out[2].redacted == "mail me: [email]"


def test_pii_odd_rows(spark):
    """Long runs of digits, repeated rows, clashing names, null keys and empty tables."""
    digits = "0" * 5000 + ".1.1.1 " + "9" * 5000 + ".1.1.1"
    rows = [(1, digits), (1, digits), (1, "a@b.cd"), (None, "1.2.3.4"), (2, "x " * 1_000_000 + "+1 555 555 5555"), (3, ""), (4, None)]
    docs = spark.createDataFrame([(t, i, "s", 5) for i, t in rows], "spans string, k long, text string, n_email int")
    got = [tuple(r) for r in pii.digest(docs, key="k", text="spans").select("k", "n_email", "n_ip", "n_phone", "n_spans").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, 0, 1)] * 2 + [(1, 1, 0, 0, 1), (None, 0, 1, 0, 1), (2, 0, 0, 1, 1), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)], key=str)
    assert pii.digest(docs.limit(0), key="k", text="spans").count() == 0
    assert pii.digest(table(spark, ["x"])).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_html(spark):
    chrome = "<nav><ul><li><a href='/'>Home of the site with many words to repeat here</a></li></ul></nav>"
    page = lambda body: f"<html><head><title>T</title><script>var a='</p>';</script></head><body>{chrome}{body}<footer>&copy; all rights</footer></body></html>"
    rows = [
        (1, "http://h.example/1", page("<article><h1>Title</h1><p><b>A &amp; b\n c<br>d<p>Second &lt;x&gt;<!-- no --><aside>ad</aside><div class='comments'>c</div></article>")),
        (2, "http://h.example/2", "<div>Home of the site with many words to repeat here</div><div>only on this page, quite alone</div>"),
        (3, None, None), (4, "", ""), (5, "http://h.example/3", "<p>unclosed <"),
    ]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Title\nA & b c d\nSecond <x>" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "only on this page, quite alone"
    assert got[3].text == "" and got[4].text == "" and got[3].n_chars == 0
    assert got[5].text == "unclosed <"


def test_html_text_beside_an_article(spark):
    same = "<div>our shop sends all orders within two days of the payment to any town</div>"
    rows = [(i, f"http://h.example/{i}", f"<body><h1>lead {i} alone</h1><article><p>story {i}</p></article><p>after {i}</p>{same}</body>") for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"lead {i} alone\nstory {i}\nafter {i}" for i in range(6)}


def test_html_repeats_of_a_host(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    menu, copied, near, phrase = say(20), say(40), say(60), say(8)
    own = [say(30) for _ in range(300)]
    rows = [(i, f"http://large.example/{i}", f"<p>{own[i]}</p>" + (f"<div>{menu}</div>" if i % 60 == 0 else "")) for i in range(300)]
    rows[7] = (7, rows[7][1], f"<p>{own[7]} {phrase} {own[7][::-1]}</p>")
    rows[8] = (8, rows[8][1], f"<p>{own[8]} {phrase} {own[8][::-1]}</p>")
    rows += [(400 + i, f"http://small.example/{i}", f"<p>{copied}</p>") for i in range(4)]
    rows += [(500 + i, f"http://near.example/{i}", f"<p>{near} {say(2)}</p>") for i in range(5)]
    rows += [(600 + i, f"http://art.example/{i}", f"<article><p>{own[i]}</p><p>{menu}</p></article>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == own[i] for i in range(0, 300, 60))  # a menu of 5 pages among 300
    assert all(phrase in got[i] for i in (7, 8))  # a phrase of two pages is no boilerplate
    assert all(got[400 + i] == copied for i in range(4)) and all(near in got[500 + i] for i in range(5))
    assert all(got[600 + i] == own[i] for i in range(6))  # repeated inside each article
    assert got == {r.page_id: r.text for r in html_extract.extract(pages, shard=7).collect()}


def test_html_odd_rows(spark):
    page = "<article><p>a story of its own</p></article>"
    rows = [(1, "http://h.example/1", page, "x"), (1, "http://h.example/1", page, "x"), (2, "http://h.example/2", "<p>" + "word " * 400_000 + "</p>", "x"), (None, "", None, "x")]
    pages = spark.createDataFrame(rows, "host long, url string, html string, p string")
    got = sorted((r.host or 0, r.n_chars) for r in html_extract.extract(pages, key="host").collect())
    assert got == [(0, 0), (1, 18), (1, 18), (2, 5 * 400_000 - 1)]
    assert html_extract.extract(pages.limit(0), key="host").count() == 0


def test_mixing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1)] * 3 + [(2, "c", "t", 1), (None, "d", "t", 1)], "doc_id long, text string, source string, _h int")
    got = mixing.mix(docs).collect()
    assert {(r.source, r.n_words) for r in got} == {("s", 2), ("t", 1)} and len({(r.block, r.position) for r in got}) == len(got)


def test_repeated_runs():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 3, 300)
    page = np.repeat(np.arange(6), 50)
    want = np.zeros(300, bool)
    at = {}
    for i in range(300 - 4):
        if page[i] == page[i + 4]:
            at.setdefault(tuple(tokens[i : i + 5]), []).append(i)
    for places in at.values():
        if len({page[i] for i in places}) > 1:
            for i in places:
                want[i : i + 5] = True
    assert (html_extract.repeated(tokens, page, 5) == want).all()


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 32))
    vecs = [b + rng.normal(size=32) * s for b in base for s in (0, 0.01, 0.05, 0.15)]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vecs)]
    rows += [(500, rows[0][1], 1), (501, None, 1), (502, [0.0] * 32, 1), (503, [float("nan")] * 32, 1), (504, [1.0, None], 1), (505, [], 1), (506, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tables=12).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i < 501 or i == 506}
    linked = lambda a, b: len(a) == len(b) and a @ b >= 0.95
    links = {i: sum(linked(v, u) for j, u in ok.items() if j != i) for i, v in ok.items()}
    assert all(got[i].n_links <= links[i] for i in ok)
    assert sum(got[i].n_links for i in ok) >= 0.9 * sum(links.values())
    assert got[500].component_id == 0 and got[500].n_links == got[0].n_links
    for i in (501, 502, 503, 504, 505):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embedding_large_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 20)
    v = np.random.default_rng(1).normal(size=16)
    rows = [(i, [float(x) for x in v + np.random.default_rng(i).normal(size=16) * 0.01]) for i in range(130)]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(129, 0)}


def test_embedding_recall_of_the_default_plan(spark):
    """Pairs just above the threshold, among other vectors and of two lengths."""
    rng = np.random.default_rng(4)
    vecs = []
    for dim in (48, 64):
        for _ in range(700):
            u, w = rng.normal(size=(2, dim))
            u /= np.linalg.norm(u)
            w -= (w @ u) * u
            c = rng.uniform(0.951, 0.97)
            vecs += [u, 3 * (c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = sum(r.n_links for r in got.values())
    assert 0.95 * 2800 <= links <= 2800 and all(got[i].component_id in (i, i - i % 2) for i in got)


def test_embedding_odd_rows(spark):
    df = "vec_id long, embedding array<double>, rep string, copies int, cell string"
    rows = [(1, [1.0, 2.0], "r", 1, "c"), (1, [1.0, 2.0], "r", 1, "c"), (2, [1.0, 2.0], "r", 1, "c"), (None, [1.0, 2.0], "r", 1, "c"), (3, [9.0, 9.0], "r", 1, "c"), (3, None, "r", 1, "c")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup.link(spark.createDataFrame(rows, df)).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3)]
    assert embedding_dedup.link(spark.createDataFrame([], df)).count() == 0
    scale, tables = zip(*[embedding_dedup.plan(n) for n in (1000, 100_000, 10_000_000, 1_000_000_000)])
    assert list(scale) == sorted(set(scale)) and list(tables) == sorted(tables)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = embedding_dedup.nearest_e8(x)
    short = embedding_dedup._minimal_vectors()
    assert len(short) == 240
    d = ((x - p) ** 2).sum(1)
    assert all((((x - (p + v)) ** 2).sum(1) >= d - 1e-9).all() for v in short)


def test_line_dedup_paths_agree(spark):
    rows = [(i, "\n".join(["Menu", f"own {i}", "", "twice", "twice"][: 2 + i % 4]), ["a", "b", None][i % 3], "x", "y") for i in range(60)]
    rows += [(100, None, "a", "x", "y"), (101, "", "b", "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    a = line_dedup.dedup(docs).orderBy("doc_id").collect()
    b = line_dedup.dedup(docs, broadcast_lines=0).orderBy("doc_id").collect()
    assert a == b and a[0].text == "own 0" and a[0].n_dropped == 1 and a[0].n == "y"
    assert a[-2].text is None and a[-1].text == ""
    assert all("own" in r.text for r in a[:60])
    assert line_dedup.dedup(table(spark, [])).count() == 0


def test_line_dedup_clashing_columns_and_repeated_rows(spark):
    names = ["doc_id", "text", "source", "_bad", "_site", "bad", "kept", "n", "row", "site", "n_lines", "a.b"]
    rows = [(i // 2, f"Menu\nown {i // 2}", "s", "b0", "mine", "b1", "k", 7, "r", "here", 99, "dot") for i in range(20)]
    rows += [(50, "x" * 3_000_000 + "\nMenu", "s", "b0", "mine", "b1", "k", 7, "r", "here", 99, "dot")]
    docs = spark.createDataFrame(rows, names)
    for most in (0, 1000):
        got = line_dedup.dedup(docs, broadcast_lines=most).collect()
        assert len(got) == 21 and all(r.n_dropped == 1 and r.n_lines == 2 and "Menu" not in r.text for r in got)
        assert {(r["_bad"], r["_site"], r.bad, r.kept, r.n, r.row, r.site, r["a.b"]) for r in got} == {("b0", "mine", "b1", "k", 7, "r", "here", "dot")}
    exact = spark.createDataFrame([(i, "tie" if i < 3 else f"own {i}", "s") for i in range(30)], "doc_id long, text string, source string")
    assert line_dedup.dedup(exact).where("n_dropped > 0").count() == 0  # 3 of 30 is not more than a tenth


def test_decontamination_slots(spark):
    items = spark.createDataFrame([(1, "the train from Rome leaves at 12 and needs 3 hours to reach the north of Rome again")], "item_id long, text string")
    docs = table(spark, [
        "so then the train from Paris leaves at 15 and needs 4 hours to reach the north of Paris again, ok",
        "so then the train from Paris leaves at 15 and needs 4 hours to reach the north of Berlin again, ok",
        "nothing of the kind is in here at all, not even in part, nor any train", None, "",
    ])
    got = {r.doc_id: r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {0} and got[0].n_slots == 4  # a name, two numbers and a unit
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 2, 3, 4]
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_of_capitalised_text(spark):
    text = "the train from Rome leaves at 12 and needs 3 hours to reach the north of Rome again"
    items = spark.createDataFrame([(1, text), (2, "Every Word Of This Title Has One Capital Letter At Least")], "item_id long, text string")
    rows = [text.upper(), "so it said: " + text.title(), "every word of this title has one capital letter", text.replace("needs", "takes").upper(), "1 2 3 4 5 6 7 8 9"]
    rows += ["x " * n + text.upper()[text.index("leaves") : text.index(" north")] for n in range(4)]  # 11 words at any offset
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, rows), items).collect()}
    assert got == {(i, 1) for i in (0, 1, 3, 5, 6, 7, 8)} | {(2, 2)}


def test_decontamination_short_items_and_slots_both_ways(spark):
    items = spark.createDataFrame([
        (1, "why does the old mill turn"), (2, "one two three"), (3, "a boat with Anna and one with Berta leaves the quay at dawn"), (4, None), (5, ""),
    ], "item_id long, text string")
    rows = [
        "he asked: Why does the old mill turn, again", "one two three", "so a boat with Carla and one with Doris leaves the quay at dawn",
        "so a boat with Carla and one with Carla leaves the quay at dawn", "the old mill turn why does", None, "", "x " * 200_000 + "why does the old mill turn",
    ]
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, rows), items).collect()}
    assert found == {(0, 1), (2, 3), (7, 1)}


def test_decontamination_repeated_rows_nulls_and_names(spark):
    text = "the train from Rome leaves at 12 and needs 3 hours to reach the north of Rome again"
    items = spark.createDataFrame([(1, text, "d"), (1, "x " + text.replace("12", "14"), "d"), (None, text, "d")], "item_id long, text string, doc_id string")
    schema = "doc_id long, text string, h string, item_id string, gram string, d string"
    rows = [(1, text), (1, text), (1, text.replace("12", "15")), (2, "quiet"), (None, text), (3, None), (3, text)]
    docs = spark.createDataFrame([(i, t, "h", "i", "g", "d") for i, t in rows], schema)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1), (3, 1)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]
    assert decontaminate.clean(docs.limit(0), items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(rows)


def test_decontamination_without_broadcasts(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == want


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "big" if i % 10 else "small", "x", "y") for i in range(500)] + [(900, None, "big", "x", "y"), (901, "a b", None, "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, entropy=0.9, max_repeats=3.0, block_tokens=100).collect()
    sizes = {i: len(t.split()) for i, t, *_ in rows if t}
    used = {}
    for r in got:
        assert r.n_words == sizes[r.doc_id]
        used[r.source] = used.get(r.source, 0) + r.n_words
    total = {"big": 0, "small": 0, None: 0}
    for i, _, s, *_ in rows:
        total[s] += sizes.get(i, 0)
    assert all(used[s] <= 3.0 * total[s] + 5 for s in used)
    assert used["small"] / sum(used.values()) > total["small"] / sum(total.values())
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert len({(r.block, r.position) for r in got}) == len(got)
    assert mixing.mix(table(spark, [])).count() == 0


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    pos = rank[y == 1]
    return (pos.sum() - len(pos) * (len(pos) - 1) / 2) / len(pos) / (len(y) - len(pos))


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, column):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = module.fit(docs, labels.where("doc_id % 4 <> 0"), label=column)
    got = module.score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").select("score", column).toPandas()
    assert got["score"].between(0, 1).all()
    assert auc(got["score"].to_numpy(), got[column].to_numpy()) > 0.9
    odd = module.score(table(spark, [None, "", "a" * 300_000, "x"]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    empty = module.fit(docs.limit(0), labels, label=column)
    assert module.score(table(spark, ["x"]), empty).count() == 1


def test_toxicity_of_long_harmless_texts_and_plain_scores(spark):
    """Scores are the noisy-or of plain sums, and do not rise to 0.5 with the number of harmless sentences."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"), label="toxic")
    held = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("doc_id", "text", "toxic").collect()
    harmless = " ".join(r.text for r in held if r.toxic == 0 and r.text)
    texts = [harmless[:300_000], harmless[:30_000], None, "", "...", *[r.text for r in held[:150]], held[0].text]
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        keep, parts = 1.0, [set(re.findall(r"\w+", x)) for x in re.split(r"[.!?\n]", t or "")]
        parts = [p for p in parts if p]
        for p in parts:
            z = model.bias - model.spread * np.log(len(parts)) + sum(model.weights[f] for w in p for f in toxicity._features(w))
            keep *= 1 - 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
        assert abs(got[i] - (1 - keep)) < 1e-6
    assert got[0] < 0.5 and got[1] < 0.5 and got[2] == got[3] == got[4] == 0 and got[5] == got[len(texts) - 1]
    flagged = {r.doc_id: r.score >= 0.5 for r in toxicity.score(spark.createDataFrame(held).select("doc_id", "text"), model).collect()}
    assert sum(flagged[r.doc_id] for r in held if r.toxic == 1) >= 0.8 * sum(r.toxic == 1 for r in held)
    assert sum(flagged[r.doc_id] for r in held if r.toxic == 0) <= 0.02 * sum(r.toxic == 0 for r in held)


def test_quality_scores_are_plain_sums(spark):
    good, bad = ["the cat sat on the mat and looked at the sea %d" % i for i in range(40)], ["zq%d xv jk%d !! qq" % (i, i) for i in range(40)]
    rows = [(i, t * 5, int(i < 40)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs.drop("label"), docs.select("doc_id", "label"))
    texts = [None, "", "x", good[3] * 400, bad[2], bad[2]]
    odd = spark.createDataFrame([(i, t, 9.0, "w") for i, t in enumerate(texts)], "doc_id long, text string, score double, w string")
    got = {r.doc_id: r for r in quality.score(odd, model, carry=["score", "w"]).collect()}
    pack = model.coders()
    for i, t in enumerate(texts):
        x = np.zeros(3)
        if t:
            sizes = [[len(c.compress(t[a : a + 2048].encode())) for c in pack] for a in range(0, len(t), 2048)]
            each = [(b - g) / (b + g) for g, b in sizes]
            g, b = (sum(s[k] for s in sizes) for k in (0, 1))
            x = np.array([(b - g) / (b + g), max(each), min(each)])
        z = model.weights[0] + model.weights[1:] @ (10 * x)
        assert abs(got[i].score - 1 / (1 + np.exp(-min(30, max(-30, z))))) < 1e-9 and got[i].w == "w"
    assert got[4].score == got[5].score and got[3].score > got[4].score
    assert quality.score(docs.limit(0), model).count() == 0
    # carried numbers stay what they are beside nulls
    wide = spark.createDataFrame([(0, "x", 2**60 + 1), (1, "x", None)], "doc_id long, text string, n long").coalesce(1)
    assert {r.doc_id: r.n for r in quality.score(wide, model, carry=["n"]).collect()} == {0: 2**60 + 1, 1: None}
    assert quality._spread([b"%d" % i for i in range(30)], 4) == [b"0", b"9", b"19", b"29"]


def test_toxicity_locates_sentences(spark):
    rng = random.Random(0)
    say = lambda: " ".join(rng.choice(["sun", "sea", "tree", "bird", "hill"]) for _ in range(5))
    rows = [(i, ". ".join([say(), say() + (" vile" if i % 2 else ""), say()]) + ".", i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "label"))
    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text", "label"), "doc_id").collect():
        assert (r.score >= 0.5) == bool(r.label)
        if r.label:
            assert "vile" in r.text[r.worst_start : r.worst_end]


def test_tables_of_few_rows_have_few_files(spark, monkeypatch):
    settings = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files, save = {k: spark.conf.get(k) for k in settings}, [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, rows=None: (out := save(self, df, rows), files.append(len(out.inputFiles())))[0])
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        scratch = Scratch(spark, "few")
        edges = spark.range(400).selectExpr("id as a", "id - id % 50 as b")
        got = {r.id: r.component for r in connected_components(scratch, edges, "a", "b", 400).collect()}
        assert got == {i: i - i % 50 for i in range(400)} and max(files) <= 32
        assert len(scratch.save(spark.range(400).groupBy((F.col("id") * 3).alias("k")).count(), 10**9).inputFiles()) > 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
