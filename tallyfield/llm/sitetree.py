"""Main texts of web pages by site style trees.

The pages of a host are merged into one tree. An element of the tree is known by its look (tag,
classes, id), its place among its siblings, and the looks of these siblings: pages that lay out an
element's children alike share the children, others branch off. Two entropies tell what matters:
the layouts of an element, over the pages that have it, are many where writers write and one where
a template repeats; and a phrase or link of a text that all pages have says nothing, one of a single
page everything. Both go up the tree as composite importance, and each page loses the branches whose
importance is low. Names count as well, as elements of the tree: menus, adverts, notices and the like
have no importance whatever their entropy, since a host with one page, or one whose menus change, shows
none. What a page itself calls its article is in the tree as all else is, and loses what repeats in
it; an article that would lose more than half is a copy of others on its host, no template, and keeps
all but its noise. Pages of a site lose what the tree says and nothing else; pages of no site have no
tree and are judged by names.

Pages leave a few numbers per element and phrase behind, never their text: the tree is aggregates over
these.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.dom import UNSEEN, Page
from tallyfield.session import checkpoint

FADE = 0.9  # how much of an element's importance is that of its children, for one layout
LEAST = 0.3  # importance of a branch that stays
PAGES = 4  # different pages that must have an element before its entropy counts
LEVELS = 64  # of the tree; what is deeper hangs from the last level, leaf by leaf
SMALL = 64 << 20  # bytes that may be broadcast
HELD = 200_000  # different rows of a task's trees that are counted before they are handed on

_TREE = "node long, up long, siblings int, level int, kind int, value long, pages long"
_PLACE = "host long, page long, at int, node long"
_PHRASE = re.compile(r"[.!?;:|·•—\n]+")
_DIGITS = re.compile("[0-9]+")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def host_of(url: str | None) -> str:
    """Host of a URL in lower case; empty where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").rstrip(".")
    except ValueError:
        return ""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _elements(page: Page, host: str) -> Iterator[tuple]:
    """(at, node, up, siblings, level, layout) of every element that a browser shows, parents first.

    ``layout`` is the hash of the looks of its children, 0 for a text or an empty element. Below the
    last level an element has all leaves and all noise of its subtree as children, each with the looks
    on the way to it as its look.
    """
    hashed = xxhash.xxh3_64_intdigest
    look, children = page.look, {}
    for i, up in enumerate(page.up):
        if look[i]:
            children.setdefault(up, []).append(i)

    def leaves(top: int) -> tuple[list[int], list[str]]:
        found, looks, way = [], [], {top: 0}
        i = top + 1
        while i < page.end[top]:
            if look[i]:
                way[i] = hashed(f"{way[page.up[i]]} {look[i]}".encode())
                if i not in children or page.noise[i]:
                    found.append(i)
                    looks.append(str(way[i]))
            i = page.end[i] if page.tag[i] in UNSEEN else i + 1
        return found, looks

    below = children.get(-1, [])
    todo = [(hashed(host.encode()), 0, below, [look[c] for c in below])]
    while todo:
        node, level, below, looks = todo.pop()
        head, up, n = f"{node} {hashed(chr(10).join(looks).encode())}", _signed(node), len(below)
        for place, (c, name) in enumerate(zip(below, looks)):
            key = hashed(f"{head} {place} {name}".encode())
            if page.noise[c]:
                # hidden or not, an element looks the same: noise is an element of its own
                key = hashed(f"{key} noise".encode())
            layout = 0
            if c in children and level < LEVELS and page.tag[c] not in UNSEEN:
                if level + 1 < LEVELS:
                    grand = children[c]
                    names = [look[g] for g in grand]
                else:
                    grand, names = leaves(c)
                todo.append((key, level + 1, grand, names))
                layout = _signed(hashed("\n".join(names).encode()))
            yield c, _signed(key), up, n, level, layout


def tree_rows(page: Page, host: str) -> Iterator[tuple]:
    """(at, node, up, siblings, level, kind, value) of all elements of a page that a browser shows.

    Kind 0 has an element's layout; kind 1 a phrase or target of a text or an image; kind 2 is noise by
    its names, whose elements have rows as others do: value 1 where a browser shows no text of it, so
    that nothing is to be taken out.
    """
    hashed = xxhash.xxh3_64_intdigest
    for c, node, up, siblings, level, layout in _elements(page, host):
        tag, at = page.tag[c], page.up[c]
        if page.noise[c]:
            yield c, node, up, siblings, level, 2, int(tag in UNSEEN)
            continue
        yield c, node, up, siblings, level, 0, layout
        if not tag:
            # numbers count in headings alone: elsewhere they are dates, pages and counters
            text = page.text[c] if at >= 0 and page.tag[at] in HEADINGS else _DIGITS.sub("0", page.text[c])
            phrases = {p for p in (x.strip().lower() for x in _PHRASE.split(text)) if p}
            target = page.text[at] if at >= 0 else ""
            if target:
                phrases.add(f"\0{target}")
            for p in phrases:
                yield c, node, up, siblings, level, 1, _signed(hashed(p.encode()))
        elif tag == "img" and page.text[c]:
            yield c, node, up, siblings, level, 1, _signed(hashed(page.text[c].encode()))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def _batch(columns: Iterator[Sequence], schema: str) -> pa.RecordBatch:
    of = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, of)], schema=of)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple] = Counter()

    def out() -> pa.RecordBatch:
        # a phrase needs no place: its element's own row has it
        rows = ((n, None, None, None, k, v, c) if k == 1 else (n, u, s, at, k, v, c) for (n, u, s, at, k, v), c in counts.items())
        return _batch(zip(*rows), _TREE)

    for batch in batches:
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            name = host_of(url)
            if name and html:
                counts.update(row[1:] for row in tree_rows(Page(html), name))
            if len(counts) > HELD:
                yield out()
                counts.clear()
    if counts:
        yield out()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for url, host, copy, html in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "page", "html")), strict=True):
            name = host_of(url)
            if name and html:
                page = Page(html)
                rows = [(host, copy, at, node) for at, node, *_ in _elements(page, name) if page.tag[at] not in UNSEEN]
                if rows:
                    yield _batch(zip(*rows), _PLACE)


def _chars(blocks: list[str]) -> int:
    return sum(map(len, blocks))


def _main_text(page: Page, gone: set[int], by_names: bool) -> str:
    marked = page.marked()
    named = {i for i, noise in enumerate(page.noise) if noise}
    if not by_names:
        # the tree says what is noise; scripts and the like have no text anyway
        page.noise = [noise and tag in UNSEEN for noise, tag in zip(page.noise, page.tag)]
    own: list[str] = []
    if marked:
        own = page.blocks(gone, marked)
        around = {i for i in gone - named for a in marked if a <= i < page.end[a] or i <= a < page.end[i]}
        if around:
            whole = page.blocks(gone - around, marked)
            if 2 * _chars(own) < _chars(whole):
                gone, own = gone - around, whole
    rest = page.blocks(gone) or page.blocks(named & gone)
    return "\n".join(own if own and 2 * _chars(own) >= _chars(rest) else rest)


def main_text(html: str, gone: set[int], by_names: bool = True) -> str:
    """Text of a page without the branches at ``gone`` and, ``by_names``, those that its names call noise.

    What the page calls its article is all of it if that holds at least half of what is left. Where
    ``gone`` has more than half of an article, the article is shared, not a template in it: it stays
    but for its noise. A page of which nothing would be left, since all its branches are shared,
    keeps them.
    """
    return _main_text(Page(html), gone, by_names)


def _texts(low: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = None if low is None else low.value

        def gone_of(page: Page, host: str) -> set[int]:
            if not host or not len(nodes):
                return set()
            places = [(at, node) for at, node, *_ in _elements(page, host) if page.tag[at] not in UNSEEN]
            mine = np.fromiter((node for _, node in places), np.int64, len(places))
            found = nodes[np.minimum(np.searchsorted(nodes, mine), len(nodes) - 1)] == mine
            return {places[i][0] for i in np.flatnonzero(found)}

        for batch in batches:
            texts = []
            listed = [None] * len(batch) if low is not None else batch.column("gone").to_pylist()
            for url, html, gone in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), listed, strict=True):
                page, host = Page(html or ""), host_of(url)
                texts.append(_main_text(page, set(gone or ()) if low is None else gone_of(page, host), not host))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"])

    return run


def importance(rows: DataFrame) -> DataFrame:
    """(node, pages, lost, most, named): the site style tree's elements on two or more pages.

    ``lost`` is 1 - importance, ``most`` the least of it in the element's subtree. An element with n
    layouts gets 1 - FADE^n of its importance from their entropy and the rest from its children,
    weighted by their layout's share of pages; a text gets it from its features. Elements of a
    single page have importance 1 and no row; noise by names has importance 0 however few its pages
    are, and whatever is in it.
    """
    place = [F.first(c, ignorenulls=True).alias(c) for c in ("up", "siblings", "level")]
    counted = rows.groupBy("node", "kind", "value").agg(F.sum("pages").alias("c"), *place)
    layout, feature, log = F.col("kind") == 0, F.col("kind") == 1, F.log(F.col("c").cast("double"))
    nodes = counted.groupBy("node").agg(
        *place,
        F.sum(F.when(~feature, F.col("c"))).alias("m"), F.sum(F.when(layout, 1)).alias("layouts"),
        F.sum(F.when(layout & (F.col("value") != 0), F.col("c"))).alias("bearing"),
        F.sum(F.when(layout, F.col("c") * log)).alias("spread"), F.max(F.col("kind")).alias("kind"),
        F.sum(F.when(feature, log)).alias("shared"), F.sum(F.when(feature, 1)).alias("features"),
    ).where("m > 1 OR kind = 2")
    full = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    fade = F.pow(F.lit(FADE), F.col("layouts"))
    by_layout = (1 - fade) * F.col("spread") / F.col("m") / full
    own = F.when(F.col("kind") == 2, 1.0).when(F.col("kind") == 1, F.col("shared") / F.col("features") / full).otherwise(by_layout)
    nodes = checkpoint(
        nodes.select(
            "node", "up", "siblings", "level", "m", own.alias("own"), F.when(F.col("kind") > 0, 0.0).otherwise(fade).alias("below"),
            F.when(F.col("kind") > 0, 0).otherwise(F.coalesce("bearing", F.lit(0))).alias("bearing"), (F.col("kind") == 2).alias("named"),
        )
    )
    deepest, first = nodes.agg(F.max("level"), F.min("level")).first()
    done = None
    for level in () if deepest is None else range(deepest, first - 1, -1):
        at = nodes.where(F.col("level") == level)
        if done is None:
            under = nodes.limit(0).select(F.col("up").alias("of"), F.col("own").alias("lost_below"), F.col("own").alias("least"), F.col("own").alias("share"))
        else:
            share = F.col("m") / F.col("siblings")
            under = done.where(F.col("level") == level + 1).groupBy(F.col("up").alias("of")).agg(
                F.sum(share * F.col("lost")).alias("lost_below"), F.min("most").alias("least"), F.sum(share).alias("share")
            )
        at = at.join(under, F.col("node") == F.col("of"), "left")
        lost = F.col("own") + F.col("below") * F.coalesce("lost_below", F.lit(0.0)) / F.col("m")
        # a child without a row is important
        whole = F.coalesce("share", F.lit(0.0)) > F.col("bearing") - 1e-6
        most = F.when(F.col("named"), 1.0).when(whole, F.least(lost, F.coalesce("least", F.lit(1.0)))).otherwise(0.0)
        new = checkpoint(at.select("node", "up", "siblings", "level", "m", lost.alias("lost"), most.alias("most"), "named"))
        done = new if done is None else done.unionByName(new)
    if done is None:
        done = nodes.select("node", "m", F.col("own").alias("lost"), F.col("own").alias("most"), "named")
    return done.select("node", F.col("m").alias("pages"), "lost", "most", "named")


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page: its article's blocks, one a line.

    Null and empty pages have an empty text. Pages without a host, null or bad URLs, belong to no
    site and are judged by names alone. Rows that repeat, or repeat a key, are pages each; equal
    pages of a host count once in its tree. A page without mark-up is all text. Other columns are
    not looked at.
    """
    p = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    # with the hash of its host, the hash of a page has 128 bits
    authority = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), "^[^/]*//([^/?#]*)", 1)
    p = p.withColumns({"host": F.xxhash64(authority), "page": F.xxhash64("html")})
    # copies of a page count once
    once = p.select("url", "host", "page", "html").where("html <> ''")
    copies = checkpoint(once.groupBy("host", "page").count().where("count > 1").select("host", "page"))
    n = copies.count()
    if n:
        copies = F.broadcast(copies) if n * 16 <= SMALL else copies
        first = once.join(copies, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])
        once = once.join(copies, ["host", "page"], "left_anti").unionByName(first)
    # noise is an element with nothing of importance in its subtree
    found = importance(once.mapInArrow(_trees, _TREE))
    low = checkpoint(found.where((F.col("named") | (F.col("pages") >= PAGES)) & (F.col("most") > 1 - LEAST)).select("node"))
    nodes = None
    if low.count() * 8 <= SMALL:
        nodes = pages.sparkSession.sparkContext.broadcast(np.sort(low.toPandas()["node"].to_numpy(np.int64)))
        out = p.select("key", "url", "html")
    else:
        places = p.select("url", "host", "page", "html").mapInArrow(_places, _PLACE)
        gone = places.join(low, "node").groupBy("host", "page").agg(F.collect_set("at").alias("gone"))
        out = p.join(gone, ["host", "page"], "left").select("key", "url", "html", "gone")
    kind = dict(pages.dtypes)
    out = out.mapInArrow(_texts(nodes), f"key {kind[key]}, url {kind[url]}, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
