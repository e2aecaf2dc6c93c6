"""Ordinary and broken HTML, and vectors of very small and very large components."""

import itertools
import math
import random
import time

import pytest

from millrace.llm import embedding_dedup, html_extract

PROBES = [
    ("<div class='content-with-sidebar'><h1>Story</h1><p>Text</div>", ["Story", "Text"]),
    ("<div class='site-footer'>Imprint</div><div class='no-sidebar'>Text</div><div class='menu-open'>More</div><p class='has-comments'>End", ["Text", "More", "End"]),
    ("<article><h1>T</h1><p class='share'>Share<p>First paragraph.<p>Second paragraph.</article>", ["T", "First paragraph.", "Second paragraph."]),
    ('<ul><li class="share">x<li>First item<ul><li>inner</ul><li>Last</ul>', ["First item", "inner", "Last"]),
    ("<dl><dt class=share>x<dd>a<dt>b</dl><table><tr class=ad><td>p<td>q<tr><td>r<td class=share>s<td>t</table>end", ["a", "b", "r", "t", "end"]),
    ('<article><p>Story</article><article class="comment"><p>reader comment</article>', ["Story"]),
    ("<p title=it's>Hello it's <b>bold</b>", ["Hello it's bold"]),
    ("<p class=a title=\"a > b\">x</p><p data-class='menu'>y</p>", ["x", "y"]),
    ("a < b and <3 &lt;p&gt; c <b", ["a < b and <3 <p> c <b"]),
    ("<div class=ad><b>x<p>y</b>still</div>z", ["z"]),
    ("<p>a<div>b</div>c<!-- <p>no --><?x?><!doctype html>d", ["a", "b", "cd"]),
    ("<script>var a = '<p>no';</script><p>yes<script/><b>too</b></script x", ["yestoo</script x"]),
]


@pytest.mark.parametrize(("source", "want"), PROBES)
def test_blocks(source, want):
    assert [x for _, _, chrome, x in html_extract.blocks(source) if not chrome] == want


@pytest.mark.parametrize("piece", ["<a ", "<p>", "<b>", '<a x="', "<div>", "</p>", "<li><ul>", "<!--", "<", "<a ='", "<td><tr>", "&amp;", "x>"])
def test_broken_pages_take_linear_time(piece):
    html_extract.blocks(piece * 100)
    began = time.process_time()
    html_extract.blocks(piece * (1_000_000 // len(piece)) + ">")
    assert time.process_time() - began < 20  # quadratic work takes hours


def test_blocks_of_generated_pages_read_back():
    """Random nesting of blocks with and without their end tags against a plain walk over the parts they were made of."""
    rng = random.Random(6)
    for n in range(500):
        out, want, i = [], [], itertools.count()

        def fill(depth, hidden):
            for _ in range(rng.randint(1, 4)):
                kind, word = rng.choice(["p", "p", "div", "ul", "dl", "inline"]), f"w{n}x{next(i)}"  # noqa: B023
                bad = rng.random() < 0.2
                mark = rng.choice([" class=sidebar", ' class="x share"', " class='main-menu'"]) if bad else rng.choice(["", " class=sidebarless", ' id="has-menu"', " title=it's"])
                if kind == "inline":
                    out.append(f"<div{mark}>{word} <i>b</i></div>")  # noqa: B023
                    text = f"{word} b"
                elif kind == "p":
                    out.append(f"<p{mark}>{word}" + rng.choice(["", "</p>"]) + "<hr>")  # noqa: B023
                    text = word
                elif kind in ("ul", "dl"):
                    item = "li" if kind == "ul" else "dd"
                    out.append(f"<{kind}><{item}{mark}>{word}<{item}>{word}y</{kind}>")  # noqa: B023
                    want.extend(x for x, b in ((word, bad), (word + "y", False)) if not b and not hidden)  # noqa: B023
                    continue
                else:
                    out.append(f"<div{mark}>{word}")  # noqa: B023
                    if not hidden and not bad:
                        want.append(word)  # noqa: B023
                    if depth < 3:
                        fill(depth + 1, hidden or bad)
                    out.append("</div>")  # noqa: B023
                    continue
                if not hidden and not bad:
                    want.append(text)  # noqa: B023

        fill(0, False)
        assert [x for _, _, chrome, x in html_extract.blocks("".join(out)) if not chrome] == want


def test_vectors_of_any_size(spark):
    rng = random.Random(9)
    rows = []
    for k in range(12):
        base = [rng.gauss(0, 1) for _ in range(6)]
        for size in (1e-300, 1e-200, 1e-20, 1.0, 1e150, 1e300):
            rows.append((len(rows), [x * size * 0.1 for x in (base if k % 2 else [b + rng.gauss(0, 0.02) for b in base])]))
    rows += [(900, [1e-200, 2e-200]), (901, [1.0, 2.0]), (902, [1e200, 2e200]), (903, [0.0, 0.0]), (904, [float("inf"), 1.0]), (905, None), (906, [5e-324, 0.0])]

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    sound = {i: v for i, v in rows if v and any(v) and all(map(math.isfinite, v))}
    links = {i: {j for j, b in sound.items() if j != i and len(a := sound[i]) == len(b) and cosine(a, b) >= 0.95} if i in sound else set() for i, _ in rows}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in links.items()}
    assert got[900] == (2, 900) and got[902] == (2, 900) and got[903] == (0, 903)
