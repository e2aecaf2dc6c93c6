"""Main text of web pages, with suffix arrays over each host's pages to find its boilerplate.

Pages are read into blocks of text.  The token streams of a host's pages (block tags and words) are concatenated and
sorted into suffix arrays, by prefix doubling as far as ``run`` tokens, one for each shard of ``SHARD`` pages.  A shard
names the runs that may be boilerplate; they are then counted over all distinct pages of the host, so that the result does
not depend on the shards and no host is gathered in one task.  What counts as main text:

* menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles never do;
* blocks of an article (or else a main) element do, less runs on half of the host's pages; if less than half of the
  article were left, it is kept whole;
* all other blocks do, beside an article as on a page without one, less runs on a tenth of the host's pages, long runs on
  three pages and runs that are chrome on another page.  A page without an article that would lose nine tenths of its text
  is a near copy rather than boilerplate and kept whole.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch, Segments, mix64, word_hashes

#: Pages of a host that share a suffix array.
SHARD = 64
#: Hosts, and pages with boilerplate, up to which they are sent to all executors; beyond it they are shuffled.
BROADCAST_HOSTS = 100_000
#: The same for runs and copied pages.
BROADCAST_ROWS = 500_000

# Kinds of tokens and levels of runs.
TEXT, ARTICLE, CHROME = range(3)
LONG, SHORT, STRONG = 1, 2, 3
# Shares of the words that must be left of an article, and of a page without one; otherwise it is kept whole.
LEFT_OF_ARTICLE, LEFT_OF_PAGE = 0.5, 0.1

# Elements and class words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
_CHROME = frozenset("nav aside footer form button dialog menu head fieldset label".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var br wbr img".split()
)
_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices popup modal overlay "
    "newsletter subscribe subscription signup login sidebar menu navbar nav navigation breadcrumb breadcrumbs pagination pager share sharing social related "
    "recommended comment comments disqus reply footer masthead toolbar widget".split()
)
_ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar".split())

#: Words that a class name may add to one of the others; with any further word the name says nothing.
_BESIDE = frozenset("site page global main top bottom left right primary secondary header inner outer container wrapper box list item bar block section area slot unit link links".split())
#: Class names that make an article of its own one of the readers' or a hint at other pages.
_ARTICLE_CLASSES = frozenset("comment comments reply disqus ad ads advert advertisement sponsored promo promotion teaser related recommended".split())
#: Elements whose start ends those before the colon, if no element after it lies between.
_IMPLIED = {
    "li": "li:ul ol menu", "dt": "dt dd:dl", "dd": "dt dd:dl", "td": "td th:table", "th": "td th:table", "tr": "tr td th:table",
    "tbody": "thead tbody tfoot tr td th:table", "thead": "thead tbody tfoot tr td th:table", "tfoot": "thead tbody tfoot tr td th:table",
} | dict.fromkeys(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(),
    "p:table td th caption button",
)
_ENDS = {name: tuple(frozenset(x.split()) for x in rule.split(":")) for name, rule in _IMPLIED.items()}

# Possessive, so that every tag is read once; quotes count after an equals sign alone.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PARTS = re.compile(r"[-_]+")


def _names_chrome(name: str) -> bool:
    words = [w for w in _PARTS.split(name) if w]
    return name in _CLASSES or not _CLASSES.isdisjoint(words) and all(w in _CLASSES or w in _BESIDE for w in words)


def _is_chrome(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _CHROME or tag == "header" and not in_main:
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        names = "".join(values).lower().split()
        if name.lower() == "role":
            if names and names[0] in _ROLES:
                return True
        elif tag == "article":
            if not _ARTICLE_CLASSES.isdisjoint(names):
                return True
        elif tag not in ("body", "html", "main") and any(map(_names_chrome, names)):
            return True
    return "hidden" in attributes and bool(re.search(r"\bhidden\b(?!=)", _ATTRIBUTE.sub("", attributes)))


def _tokens(source: str):
    """Pieces of text, as strings, and tags, as matches of ``_TAG``; elements without readable content are passed over.

    Comments and declarations are left out, a tag that does not end is text. Every character is looked at a bounded number of times."""
    at, last = 0, source.rfind(">")
    while at < len(source):
        start = source.find("<", at)
        if start < 0 or start > last:  # no tag any more
            yield source[at:]
            return
        if start > at:
            yield source[at:start]
        if source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else len(source)
        elif source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
        elif m := _TAG.match(source, start):
            at = m.end()
            name = m[2].lower()
            if name in _RAW and not m[1]:
                if not m[3].endswith("/"):
                    stop = re.compile(rf"</{name}\s*+>", re.I).search(source, at)
                    at = stop.end() if stop else len(source)
            else:
                yield m
        else:
            yield "<"
            at = start + 1


def blocks(source: str | None) -> list[tuple[str, str, bool, str]]:
    """(region, tag, chrome, text) of each block with text, in page order; region is article, main or an empty string.

    An element that HTML ends without an end tag ends where it must: a paragraph before the next block, an item, a term, a
    row or a cell before the next one."""
    out: list[tuple[str, str, bool, str]] = []
    stack: list[tuple[str, bool]] = []
    is_open: dict[str, int] = {}
    chrome = depth_article = depth_main = 0
    parts: list[str] = []
    tag = ""

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            region = "article" if depth_article else "main" if depth_main else ""
            out.append((region, tag, chrome > 0, text))
        parts.clear()

    def pop_to(depth: int) -> None:
        nonlocal chrome, depth_article, depth_main, tag
        while len(stack) > depth:
            top, bad = stack.pop()
            if bad:
                end()
            is_open[top] -= 1
            chrome -= bad
            depth_article -= top == "article"
            depth_main = max(0, depth_main - (top == "main"))
        tag = stack[-1][0] if stack else ""

    for m in _tokens(source or ""):
        if isinstance(m, str):
            parts.append(entities.unescape(m) if "&" in m else m)
            continue
        name = m[2].lower()
        if not m[1]:
            if name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
                continue
            if name in _ENDS and any(is_open.get(x) for x in _ENDS[name][0]):
                closed, beyond = _ENDS[name]
                depth = None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in beyond:
                        break
                    if stack[k][0] in closed:
                        depth = k
                        if name in ("li", "dt", "dd", "td", "th") or closed == {"p"}:
                            break
                if depth is not None:
                    end()
                    pop_to(depth)
            if name in _VOID:
                if name == "hr":
                    end()
                continue
            bad = _is_chrome(name, m[3], depth_article + depth_main > 0)
            if name not in _INLINE or bad:
                end()
                tag = name
            if m[3].endswith("/") and name not in ("p", "div", "a", "span"):
                continue
            stack.append((name, bad))
            is_open[name] = is_open.get(name, 0) + 1
            chrome += bad
            depth_article += name == "article"
            depth_main += name == "main" or 'role="main"' in m[3]
        elif is_open.get(name):
            depth = len(stack) - 1
            while stack[depth][0] != name:
                depth -= 1
            if name not in _INLINE:
                end()
            elif any(x not in _INLINE for x, _ in stack[depth:]):
                continue  # an inline end does not close the blocks within
            pop_to(depth)
    end()
    return out


def runs(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array as far as ``run`` tokens: starts of runs that lie in one page, in order of their tokens, and where in
    it each distinct run begins; pages are consecutive in ``tokens``."""
    n = len(tokens)
    if n < run:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < run:
        step = min(have, run - have)
        rank = np.unique(rank[: len(rank) - step] * np.int64(n + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        have += step
    order = np.argsort(rank, kind="stable")
    order = order[page[order] == page[order + run - 1]]
    if not len(order):
        return order, order
    return order, np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))


def _cover(n: int, start: np.ndarray, run: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + run, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that two distinct pages hold; pages are consecutive in ``tokens``."""
    order, first = runs(tokens, page, run)
    if not len(order):
        return np.zeros(len(tokens), bool)
    low, high = np.minimum.reduceat(page[order], first), np.maximum.reduceat(page[order], first)
    return _cover(len(tokens), order[np.repeat(low < high, np.diff(np.append(first, len(order))))], run)


class _Page:
    """Blocks of a page, its token hashes, the kind of each token (text, article or chrome) and the hash of each run."""

    def __init__(self, host: str, source: str | None, run: int):
        self.blocks = blocks(source)
        regions = {r for r, _, bad, _ in self.blocks if r and not bad}
        main = "article" if "article" in regions else "main"
        words, kinds, self.spans = [], [], []
        for region, tag, bad, text in self.blocks:
            kind = CHROME if bad else ARTICLE if region == main else TEXT
            parts = text.split(" ")
            self.spans.append((kind, len(words) + 1, parts))
            words += [f"<{tag}>", *parts]
            kinds += [kind] * (len(parts) + 1)
        self.tokens = word_hashes([w.encode("utf-8", "replace") for w in words])
        n, edge = max(0, len(words) - run + 1), np.zeros((3, len(words) + 1), np.int64)
        at = np.arange(n)
        self.hashes = np.empty(0, np.int64)
        self.inside = np.zeros((3, n), np.int64)  # how many tokens of each kind a run has
        if n:
            self.hashes = mix64(Segments(self.tokens).at(at, at + run) ^ np.uint64(xxhash.xxh64_intdigest(host.encode("utf-8", "replace")))).astype(np.int64)
            edge[:, 1:] = np.cumsum(np.array(kinds) == np.array([[TEXT], [ARTICLE], [CHROME]]), axis=1)
            self.inside = edge[:, run:] - edge[:, :-run]

    def text(self, level: dict[int, int] | None, run: int) -> str:
        """What is left without the runs of ``level`` (see ``boilerplate``)."""
        n = len(self.tokens)
        gone = {TEXT: np.zeros(n, bool), ARTICLE: np.zeros(n, bool)}
        if level:
            of = np.array([level.get(h, 0) for h in self.hashes.tolist()])
            lone = _cover(len(of), np.flatnonzero(of >= LONG), 1)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], lone, [0]])))
            starts = [np.arange(a, b) for a, b in zip(edge[::2], edge[1::2]) if b - a > run]  # 2 * run tokens and more
            gone[TEXT] = _cover(n, np.concatenate([np.flatnonzero(of >= SHORT), *starts]).astype(np.int64), run)
            gone[ARTICLE] = _cover(n, np.flatnonzero(of >= STRONG), run)
            least = LEFT_OF_ARTICLE if any(k == ARTICLE for k, _, _ in self.spans) else LEFT_OF_PAGE
            guarded = ARTICLE if least == LEFT_OF_ARTICLE else TEXT
            left = np.concatenate([~gone[guarded][a : a + len(x)] for k, a, x in self.spans if k == guarded] or [[True]])
            if left.mean() < least:
                gone[guarded][:] = False
        kept = []
        for kind, at, parts in self.spans:
            if kind != CHROME:
                rest = [w for w, g in zip(parts, gone[kind][at : at + len(parts)]) if not g]
                if rest:
                    kept.append(" ".join(rest))
        return "\n".join(kept)


def candidates(host: str, pages: list[str | None], run: int, least_share: float, whole: bool) -> np.ndarray:
    """Hashes of the runs of one shard that may be boilerplate of the host, from the shard's suffix array.

    Runs with a token outside articles and chrome need the host's count, unless the shard is the ``whole`` host and no
    other page holds them.  A run of an article is on ``least_share`` of the host's pages only if it is on that share of
    the pages of some shard.
    """
    read = [_Page(host, p, run) for p in pages]
    tokens = np.concatenate([p.tokens for p in read]) if read else np.empty(0, np.uint64)
    page = np.repeat(np.arange(len(read)), [len(p.tokens) for p in read])
    order, first = runs(tokens, page, run)
    if not len(order):
        return np.empty(0, np.int64)
    pad = lambda x: np.concatenate([x, np.zeros(min(run - 1, len(p.tokens)), x.dtype)])
    hashes, loose, fixed = [], [], []
    for p in read:
        hashes.append(pad(p.hashes))
        loose.append(pad(p.inside[TEXT]))
        fixed.append(pad(p.inside[ARTICLE]))
    hashes, loose, fixed = np.concatenate(hashes), np.concatenate(loose)[order], np.concatenate(fixed)[order]
    size = np.diff(np.append(first, len(order)))
    group = np.repeat(np.arange(len(first)), size)
    holders = np.bincount(np.unique(group * len(read) + page[order]) // len(read), minlength=len(first))
    ok = (np.maximum.reduceat(loose, first) > 0) & (holders > (1 if whole else 0))
    enough = holders >= least_share * len(read)
    if whole:
        enough &= holders > 3
    ok |= (np.maximum.reduceat(fixed, first) > 0) & enough
    return hashes[order[first[ok]]]


def boilerplate(rows: DataFrame, scratch: Scratch, run: int, shard: int, share: float, protect: float) -> DataFrame | None:
    """(p, runs) of pages that hold boilerplate, as hashes of runs and their levels; None if there is none.

    ``rows`` has host, p (a hash of host and page, so copies of a page are one), k (of key and url) and html_.  STRONG runs
    are on the share ``protect`` of a host's distinct pages and on 4 at least; SHORT ones on ``share`` and 3, or on 2 of
    which one has them in its chrome; LONG ones on 3, and count only where they make up ``2 * run`` tokens or more.
    """
    rows = rows.where("html_ is not null")
    same = scratch.save(rows.groupBy("host", "p").agg(F.min("k").alias("one"), F.count("*").alias("n")))
    small = lambda df, most: F.broadcast(df) if df.count() <= most else df
    hosts = small(scratch.save(same.groupBy("host").agg(F.count("*").alias("pages"))), BROADCAST_HOSTS)
    copies = small(scratch.save(same.where("n > 1").select("p", "one")), BROADCAST_ROWS)
    rows = rows.join(hosts, "host").join(copies, "p", "left").where("one is null or one = k")
    rows = rows.select("host", "p", "html_", "pages", F.pmod("k", F.ceil(F.col("pages") / shard)).cast("int").alias("shard"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("p")
        return pd.DataFrame({"h": candidates(pdf["host"].iloc[0], list(pdf["html_"]), run, protect, pdf["pages"].iloc[0] <= shard)})

    found = scratch.save(rows.groupBy("host", "shard").applyInPandas(find, "h long").distinct())
    count = found.count()
    if not count:
        return None
    known = rows.sparkSession.sparkContext.broadcast(np.array(sorted(r.h for r in found.collect()), np.int64)) if count <= BROADCAST_ROWS else None

    def look(batches):
        for pdf in batches:
            out = []
            for host, p, source, n in zip(pdf["host"], pdf["p"], pdf["html_"], pdf["pages"]):
                got = _Page(host, source, run)
                ok = np.isin(got.hashes, known.value) if known else np.ones(len(got.hashes), bool)
                if ok.any():
                    chrome = set(got.hashes[ok & (got.inside[CHROME] == run)].tolist())
                    out += [(h, p, h in chrome, n) for h in set(got.hashes[ok].tolist())]
            yield pd.DataFrame(out, columns=["h", "p", "chrome", "pages"])

    hits = rows.select("host", "p", "html_", "pages").mapInPandas(look, "h long, p long, chrome boolean, pages long")
    hits = scratch.save(hits if known else hits.join(found, "h", "left_semi"))
    n, pages = F.col("n"), F.col("pages")
    level = (
        F.when(n >= F.greatest(F.lit(4), pages * protect), STRONG)
        .when((n >= F.greatest(F.lit(3), pages * share)) | F.col("chrome") & (n >= 2), SHORT).when(n >= 3, LONG)
    )
    levels = hits.groupBy("h").agg(F.count_distinct("p").alias("n"), F.max("chrome").alias("chrome"), F.max("pages").alias("pages"))
    levels = small(scratch.save(levels.select("h", level.alias("level")).where("level is not null")), BROADCAST_ROWS)
    marks = hits.select("h", "p").distinct().join(levels, "h")
    return small(scratch.save(marks.groupBy("p").agg(F.collect_list(F.struct("h", "level")).alias("runs"))), BROADCAST_HOSTS)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", run: int = 8, shard: int = SHARD,
            share: float = 0.1, protect: float = 0.5) -> DataFrame:
    """(key, url, text, n_chars) of every page.  A null or empty page has an empty text; pages without a host form one group.

    Pages are read whole and every row is returned; rows that repeat a page count once for its host and get the same text.
    Where counts tie with a bound, the run counts as boilerplate.  An empty table gives no rows.  Other columns play no part,
    whatever their names; the key may be called anything but url, text or n_chars.
    ``shard`` sets the work of a task, not the result; for ``share`` and ``protect`` see ``boilerplate``.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key).alias("id_"), F.col(url).alias("url_"), F.col(html).alias("html_"), host.alias("host"))
    rows = rows.withColumn("p", F.xxhash64("host", "html_")).withColumn("k", F.xxhash64("id_", "url_"))
    marks = boilerplate(rows.select("host", "p", "k", "html_"), Scratch(pages.sparkSession, "html-extract"), run, shard, share, protect)
    if marks is None:
        rows = rows.withColumn("runs", F.lit(None).cast("array<struct<h:bigint,level:int>>"))
    else:
        rows = rows.join(marks, "p", "left")
    kind = pages.schema[key].dataType.simpleString()

    def cut(batches):
        for pdf in batches:
            texts = []
            for source, host, found in zip(pdf["html_"], pdf["host"], pdf["runs"]):
                level = None if found is None else {r["h"]: r["level"] for r in found}
                texts.append(_Page(host, source, run).text(level, run))
            yield pd.DataFrame({key: pdf["id_"], "url": pdf["url_"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.select("id_", "url_", "html_", "host", "runs").mapInPandas(cut, f"{key} {kind}, url string, text string, n_chars long")
