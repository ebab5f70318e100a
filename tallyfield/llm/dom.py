"""Web pages as flat trees: what the extraction of main texts needs of HTML, and no more."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache
from html.parser import HTMLParser

# Elements of HTML by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img br".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
CELLS = frozenset("td th caption table template button object".split())  # nothing inside closes what is outside
# an open element of the first set ends where one of these starts, up to the nearest of the second set
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
UNSEEN = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map select textarea "
    "button input datalist".split()
)
ASIDE = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond replies cookie "
    "cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay share sharing social "
    "related recommended widget widgets pagination pager skip copyright".split()
)
HEADS = frozenset("header head topbar".split())
CONTENT = frozenset("article content entry main post story text body title".split())
NEGATED = frozenset("no not has with without".split())
BLANK = " \t\n\x0b\f\r"
SPACE = re.compile(r"[\x09-\x0d][\x20\x09-\x0d]*|\x20[\x20\x09-\x0d]+")  # all but a single space
_UNFINISHED = re.compile("<[A-Za-z/!?]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(1 << 16)
def noisy(tag: str, classes: str, ident: str, role: str) -> bool:
    """Whether the names of an element say that it is no part of an article."""
    if tag in UNSEEN or tag in ASIDE or role in ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name in (*classes.split(), ident):
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & NEGATED:
            continue
        if parts & NOISE or (parts & HEADS and not parts & CONTENT):
            return True
    return False


@lru_cache(1 << 16)
def presentation(tag: str, classes: str, ident: str) -> str:
    """Tag, classes and id of an element, without the numbers that tell items apart."""
    return f"{tag}.{'.'.join(sorted(classes.split()))}#{re.sub('[0-9]+', '0', ident)}"


class Page(HTMLParser):
    """Elements and texts of a page in document order, with parents and ends.

    Tags that are missing are implied as browsers imply them: a paragraph ends where a block starts,
    an item where the next one does. End tags without a start and unfinished tags are nothing.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []  # "" for a text
        self.text: list[str] = []
        self.look: list[str] = []
        self.up: list[int] = []
        self.end: list[int] = []  # first node behind the subtree
        self.noise: list[bool] = []  # by its names
        self._open: list[int] = []
        self._names: Counter[str] = Counter()
        self.feed(html)
        if self.cdata_elem or _UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self._pop(0)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are XML; in HTML they are comments."""
        return self.parse_bogus_comment(i, report)

    def unknown_decl(self, data: str) -> None:
        """Nothing to show."""

    def _add(self, tag: str, text: str, look: str, noise: bool) -> int:
        i = len(self.tag)
        self.tag.append(tag)
        self.text.append(text)
        self.look.append(look)
        self.up.append(self._open[-1] if self._open else -1)
        self.end.append(i + 1)
        self.noise.append(noise)
        return i

    def _pop(self, depth: int) -> None:
        for i in self._open[depth:]:
            self.end[i] = len(self.tag)
            self._names[self.tag[i]] -= 1
        del self._open[depth:]

    def _end(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str], over: frozenset[str] | None = None) -> None:
        """Close the outermost open element of ``names`` below the nearest of ``stop``."""
        if not any(self._names[n] for n in names):
            return
        found = None
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self.tag[self._open[depth]]
            if tag in names:
                found = depth
            elif tag in stop or (over is not None and tag not in over):
                break
        if found is not None:
            self._pop(found)

    def handle_starttag(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._end({"p"}, CELLS, INLINE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        text = classes = ident = role = ""
        hidden = False
        if attrs:
            a = {k: v or "" for k, v in reversed(attrs)}
            classes, ident, role = a.get("class", ""), a.get("id", ""), a.get("role", "").lower()
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            text = a.get("href") or a.get("src") or ""
        i = self._add(tag, text, presentation(tag, classes, ident), hidden or noisy(tag, classes, ident, role))
        if tag == "header" and not self._names["article"] and not self._names["main"]:
            self.noise[i] = True
        if tag not in VOID:
            self._open.append(i)
            self._names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self._names["p"]:  # an empty paragraph
            self._add("p", "", "", False)
        if not self._names[tag] or tag in ("html", "body"):
            return
        stop = frozenset() if tag in CELLS or tag in ("tr", "tbody", "thead", "tfoot") else CELLS
        over = INLINE if tag in INLINE or tag == "p" else None
        for depth in range(len(self._open) - 1, -1, -1):
            at = self.tag[self._open[depth]]
            if at == tag:
                self._pop(depth)
                return
            if at in stop or (over is not None and at not in over):
                return

    def handle_data(self, data: str) -> None:
        i = self._add("", data, "#text", False)
        if not data.strip(BLANK):
            self.look[i] = ""  # part of the text, not of the tree

    def updatepos(self, i: int, j: int) -> int:
        """No line numbers are asked for."""
        return j

    def marked(self) -> list[int]:
        """Elements that the page itself calls its article, outside of each other and of noise."""
        for name in ("article", "main"):
            found, i = [], 0
            while i < len(self.tag):
                if self.noise[i]:
                    i = self.end[i]
                elif self.tag[i] == name:
                    found.append(i)
                    i = self.end[i]
                else:
                    i += 1
            if found:
                return found
        return []

    def blocks(self, gone: set[int], parts: Sequence[int] | None = None) -> list[str]:
        """Texts of the blocks in page order, without the branches at ``gone`` and those of noise.

        ``parts`` are the only subtrees to read. White space is one space, and a break of a line is
        white space. Blocks without a text are left out.
        """
        out: list[str] = []
        held: list[str] = []

        def flush() -> None:
            if held:
                text = SPACE.sub(" ", "".join(held)).strip(" ")
                if text:
                    out.append(text)
                held.clear()

        for first, last in [(0, len(self.tag))] if parts is None else [(i, self.end[i]) for i in parts]:
            i, ends = first, []
            while i < last:
                while ends and ends[-1] <= i:
                    ends.pop()
                    flush()
                tag = self.tag[i]
                if self.noise[i] or i in gone:
                    if tag not in INLINE and tag not in UNSEEN:
                        flush()
                    i = self.end[i]
                    continue
                if not tag:
                    held.append(self.text[i])
                elif tag == "br":
                    held.append(" ")
                elif tag not in INLINE:
                    flush()
                    ends.append(self.end[i])
                i += 1
            flush()
        return out
