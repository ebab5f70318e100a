"""Prefix trie, main texts and filter audit against SQL, brute force and planted cases."""

import hashlib
import html as H
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline  # noqa: F401  workers take the package's functions and constants as they are here
from tallyfield.llm import audit, queries, sitetree, trie
from tallyfield.llm.dom import Page
from tallyfield.operators import ordered

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_filter_audit"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(cols).collect()), key=str)
    assert got == sorted(con.sql(queries.ORACLES[name]).select(",".join(cols)).fetchall(), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text)


def trie_of(convs):
    """Nodes of the trie of {id: [(role, text)]}, by walking every prefix."""
    members, out = defaultdict(list), []
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(words(q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in ids if tuple(convs[c]) == p)
        out.append((ids[0], len(p), members[p[:-1]][0] if p else None, len(ids), sum(len(q) == len(p) + 1 for q in under),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def run_trie(df):
    conv = F.col("conv")
    parts = trie.rebuilt(trie.numbered(df), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, trie.trie(*parts).select(cols).collect()), key=str)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_trie_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(trie, "Ordered", lambda df, by, order: ordered.Ordered(df, by, order, limit))
    rnd, rows, own = random.Random(5), [], {}
    for c in [*range(1, 45), *range(-25, -3), 300]:  # 0 and 280 are not there: no turns to take
        turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "b c", ""])) for _ in range(rnd.randint(1, 5))]
        own[c] = turns
        rows += [(c, t, *x, "q") for t, x in enumerate(turns)]
    rnd.shuffle(rows)
    # a third of all rows are copies of one conversation
    for c in range(1000, 1040):
        own[c] = [("user", "same"), ("assistant", "again and again")]
        rows += [(c, t, *x, "q") for t, x in enumerate(own[c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    assert run_trie(df) == trie_of(rebuild(own))


def test_trie_edges(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    # crc32 of 43, 45 and 47 by 4 is looked up, not assumed
    rows = [
        (43, 1, "user", None), (43, None, None, "first"), (43, 2, "user", long), (43, 2, "user", long), (None, 0, "user", "lost"),
        (45, 0, "user", ""), (47, 0, "user", ""), (47, None, "", "first"),
    ]
    extra = "depth string, p1 string, weight string, of string"
    df = spark.createDataFrame([(*r, *"wxyz") for r in rows], f"conv_id long, turn long, role string, text string, {extra}")
    own = {43: [("", "first"), ("user", ""), ("user", long), ("user", long)], 45: [("user", "")], 47: [("", "first"), ("user", "")]}
    assert run_trie(df) == trie_of(rebuild(own))
    assert run_trie(df.limit(0)) == []
    none = run_trie(df.where("conv_id is null"))
    assert none == []
    ties = spark.createDataFrame([(20, 0, "u", x) for x in "abcd"], "conv_id long, turn long, role string, text string")
    assert run_trie(ties.repartition(3)) == run_trie(ties.orderBy(F.desc("text")))


def masks_of(docs, labels):
    first, good, toxic = {}, Counter(), Counter()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    out = []
    for i, text, lang in docs:
        t, w = text or "", words(text or "")
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i)
        out.append((lang or "", fails, i is not None and good[i], i is not None and toxic[i]))
    return out


def audit_of(docs, labels):
    rows, out, by = masks_of(docs, labels), [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                by[part, f] = by.get((part, f), 0) + len(gone)
                out.append([part, "".join("ABCDE"[o] for o in order), step, len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                            sum(r[1][f] and sum(r[1]) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((*r[:-1], by[r[0], r[-1]]) for r in out)


def test_audit_against_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(250))
    texts = [long, long + " Z" * 90, "same " * 300, "short $", None, "", long + " #", long.upper(), "x" * 50_000]
    rnd = random.Random(3)
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(120)]
    docs += [(i, long, "en") for i in range(100, 160)] + [(None, long, "en")] * 60  # a hot text, and a hot null key
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 160, 2), 4, 4, None, 9999]]
    schema = "doc_id long, text string, lang string"
    extra = [F.lit("x").alias(c) for c in ("mask", "part", "k", "id", "spread", "quality", "n")]
    d = spark.createDataFrame(docs, schema).select("*", *extra)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("*", F.lit("x").alias("mask"), F.lit(0).alias("spread"))
    run = lambda d, lab: audit.audited(audit.failure_masks(d, lab, audit.text_filters()), "ABCDE")
    assert sorted(map(tuple, run(d, lab).collect())) == audit_of(docs, labels)
    assert sorted(map(tuple, run(d, lab.limit(0)).collect())) == audit_of(docs, [])
    assert run(d.limit(0), lab).count() == 0


def test_diagram_keeps_counts_under_swaps():
    rnd = random.Random(1)
    counts = {m: (rnd.randint(0, 9), rnd.randint(0, 3)) for m in range(32) if rnd.random() < 0.7}
    tree, seen = audit.Diagram(5, counts), set()
    for level in [None, *audit.single_swaps(5)]:
        if level is not None:
            tree.swap(level)
        seen.add(tuple(tree.order))
        before = 0
        for bit, removed, kept in tree.steps():
            hit = [w for m, w in counts.items() if not m & before and m >> bit & 1]
            before |= 1 << bit
            left = [w for m, w in counts.items() if not m & before]
            assert removed == tuple(map(sum, zip((0, 0), *hit))) and kept == tuple(map(sum, zip((0, 0), *left)))
        assert tree.only(2) == counts.get(4, (0, 0))
    assert len(seen) == 120
    same = audit.Diagram(5, {m: (1,) for m in range(32)})
    assert [len(x) for x in same.levels] == [1] * 5  # equal branches are shared
    with pytest.raises(ValueError):
        audit.audited(None, "ABCDEFGH")


def test_main_texts_of_marked_pages(spark):
    def truth(h):
        a = re.search(r"<article>(.*)</article>", h, re.S).group(1)
        lines = [H.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?p>|</?h1>", a)]
        return "\n".join(t for t in (re.sub(r"[\x20\x09-\x0d]+", " ", x).strip() for x in lines) if t)

    want = {r.page_id: truth(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op12_main_text"](spark, SF).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


WHOLE = """<body class="has-sidebar"><header>Site</header><div id=topMenu>menu</div><main><article class="post-12 with-comments">
<header><h1>Title &amp; more</h1></header><p>One<b> two</b>&nbsp;three<br>four<p>five <i>si</i>x<div class="ad-box">Buy</div>
<ul><li>a<li>b</ul><form>Name <input></form><section id="comments"><p>Nice!</section><table><tr><td>c<td>d</table><pre> e
 f</pre></article></main><aside>Near</aside><div role=alert>Cookies</div><div class="cookie-notice">OK?</div><p hidden>No<noscript>js</noscript>"""


def test_names_and_missing_tags():
    # a no-break space is no white space of HTML
    assert sitetree.main_text(WHOLE, set()) == "Title & more\nOne two\xa0three four\nfive six\na\nb\nc\nd\ne f"
    cases = {
        "plain": "plain", "": "", "<p>a<div>b</div>c": "a\nb\nc", "a<script>if (x<p>1) '</p>'</script>b": "ab", "<![foo[x]]>y": "y",
        "<title>t</title><body>b": "b", "x <!-- <p>no</p> --> y": "x y", "a<": "a<", "b<p": "b", "&#x41;&eacute;&lt;p&gt;": "Aé<p>",
        "<div>" * 3000 + "deep": "deep", "</div></p>z": "z", "<article>short</article><div>" + "long text " * 20 + "</div>": "short\n" + ("long text " * 20).strip(),
    }
    assert {h: sitetree.main_text(h, set()) for h in cases} == cases


def site(n, rnd):
    w = lambda k: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(k))
    for i in range(n):
        text = [w(3), *(f"{w(12)}. {w(6)}." for _ in range(1 + i % 4))]
        body = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
        yield text, (
            f'<html><body><div class="c1"><span>Welcome to our place</span> <a href="/">Home</a></div><div class="c2">{body}'
            f'<div>Like it? Tell your friends.</div></div><div class="c3">Call us at 555-{i}! Open every day.</div></body></html>'
        )


def test_templates_without_names_are_found(spark):
    pages = list(site(30, random.Random(2)))
    rows = [(i, f"https://S.example.com/{i}", h) for i, (_, h) in enumerate(pages)]
    rows += [(100 + i, "https://s.example.com/copy", pages[3][1]) for i in range(40)]  # copies are no template
    rows += [(200, "https://alone.example.com/", pages[5][1]), (201, None, pages[6][1]), (202, "http://[x", "<p>odd"), (203, "", None), (None, "u", ""), (203, "", None)]
    extra = [F.lit("x").alias(c) for c in ("key", "host", "page", "gone", "at", "node")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *extra)
    got = defaultdict(list)
    for r in sitetree.extracted(df).collect():
        got[r.page_id].append(r.text)
    for i, (text, _) in enumerate(pages):
        assert got[i] == ["\n".join(text)]
    assert all(got[100 + i] == ["\n".join(pages[3][0])] for i in range(40))
    # one page of a host shows no template; names are all there is
    assert got[200][0].startswith("Welcome to our place Home") and got[202] == ["odd"] and got[203] == ["", ""] and got[None] == [""]
    assert sitetree.extracted(df.limit(0)).count() == 0


def test_pages_lose_what_the_tree_says(spark):
    side = '<div class="ad">Buy</div><nav><a href="/">Home</a></nav>'
    html = f'<body>{side}<article><h1>Title</h1><p>One</p><div class="share">Tell</div><p hidden>No</p></article></body>'
    shown = html.replace(" hidden", "")
    df = spark.createDataFrame([(1, "https://a.example.com/1", html), (2, "https://a.example.com/2", shown), (3, None, html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitetree.extracted(df).collect()}
    assert got == {1: "Title\nOne", 2: "Title\nOne\nNo", 3: "Title\nOne"}
    # without the tree's branches the names take nothing out
    assert sitetree.main_text(html, set(), False) == "Title\nOne\nTell\nNo"
    noise = {r[0] for r in sitetree.tree_rows(Page(html), "a.example.com") if r[5] == 2}
    assert sitetree.main_text(html, noise, False) == "Title\nOne"


def whole_pages():
    """(url, html, text): a marked article with a template in it, on a site whose pages nest deeply, and copies."""
    rnd = random.Random(4)
    say = lambda k: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(k))
    for i in range(8):
        own = [say(4), say(30), say(30)]
        html = f'<nav><a href="/{i}">Home</a></nav><article><h1>{own[0]}</h1><p>{own[1]}</p><div class="x7">Like it? Tell your friends.</div><p>{own[2]}</p></article>'
        yield f"https://in.example.com/{i}", f"<body>{html}</body>", "\n".join(own)
        deep = f"<p>Call us. Open every day.</p><p>{own[1]}</p>"
        yield f"https://deep.example.com/{i}", f"<body>{'<div>' * 90}{deep}{'</div>' * 90}<p>{own[2]}</p></body>", "\n".join(own[1:])
    paragraphs = [say(20) for _ in range(6)]
    for i in range(8):  # near copies, of which each has an edit of its own
        mine = [say(20) if k == i % 6 else t for k, t in enumerate(paragraphs)]
        html = "".join(f"<p>{t}</p>" for t in mine)
        yield f"https://copies.example.com/{i}", f"<body><div>{say(3)}</div><article>{html}</article></body>", "\n".join(mine)


@pytest.mark.parametrize("small", [sitetree.SMALL, -1])
def test_whole_pages_are_in_the_tree(spark, monkeypatch, small):
    monkeypatch.setattr(sitetree, "SMALL", small)  # below 0 nothing is broadcast
    monkeypatch.setattr(sitetree, "LEVELS", 6)  # a round of each level
    pages = list(whole_pages())
    rows = [(i, url, html) for i, (url, html, _) in enumerate(pages)]
    rows += [(len(pages), *pages[0][:2])] * 30  # copies of a page count once
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sitetree.extracted(df).collect()
    assert len(got) == len(rows) and all(r.text == [*pages, pages[0]][r.page_id][2] for r in got)


def test_every_element_has_a_row():
    html = (
        '<head><title>t</title></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><article><h1>T</h1><p>One <b>two</b></p>'
        f'<div class="share">Tell <i>all</i></div></article>{"<div>" * 70}<p>deep<img src="i"></p><aside>side</aside>{"</div>" * 70}</body>'
    )
    page = Page(html)
    rows = list(sitetree.tree_rows(page, "a.example.com"))
    listed = {r[0] for r in rows if r[5] != 1}
    hidden = {k for i, t in enumerate(page.tag) if t in ("head", "title") for k in range(i + 1, page.end[i])}
    shown = {i for i in range(len(page.tag)) if page.look[i] and i not in hidden}
    # on the way from the last level to its leaves, elements are part of the looks of the leaves
    assert {page.tag[i] for i in shown - listed} == {"div", "p"} and len(shown - listed) == 8
    assert {page.text[i] for i in listed if not page.tag[i]} == {"A", "T", "One ", "two", "Tell ", "all", "deep", "side"}
    assert len({r[1] for r in rows if r[5] != 1}) == len(listed) and max(r[4] for r in rows) == sitetree.LEVELS


def test_importance_against_brute_force(spark):
    pages = [h for _, h in site(12, random.Random(7))]
    rows = [(f"https://s.example.com/{i}", 1, i, h) for i, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "url string, host long, page long, html string")
    got = {r.node: (r.pages, r.lost, r.most) for r in sitetree.importance(df.mapInArrow(sitetree._trees, sitetree._TREE)).collect()}
    layouts, features, up, siblings = defaultdict(Counter), defaultdict(Counter), {}, {}
    for h in pages:
        for _, node, parent, k, _, kind, value in sitetree.tree_rows(Page(h), "s.example.com"):
            (features if kind == 1 else layouts)[node][value] += 1
            up[node], siblings[node] = parent, k
    below = defaultdict(list)
    for node, parent in up.items():
        below[parent].append(node)

    def lost(node):
        m = sum(layouts[node].values())
        if m == 1:
            return 0.0, 0.0
        if features[node]:
            x = sum(math.log(c) for c in features[node].values()) / len(features[node]) / math.log(m)
            return x, x
        n = len(layouts[node])
        entropy = -sum(c / m * math.log(c / m, m) for c in layouts[node].values())
        under = [(sum(layouts[c].values()) / m / siblings[c], *lost(c)) for c in below[node]]
        x = (1 - 0.9**n) * (1 - entropy) + 0.9**n * sum(w * u for w, u, _ in under)
        return x, min([x, *(y for _, _, y in under)])

    want = {n: (sum(layouts[n].values()), *lost(n)) for n in layouts if sum(layouts[n].values()) > 1}
    assert set(got) == set(want)
    assert all(got[n][0] == want[n][0] and got[n][1:] == pytest.approx(want[n][1:], abs=1e-9) for n in want)
