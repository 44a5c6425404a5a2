"""Operator 10 — main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted by its links: with C characters and T tags
below it, of which LC and LT are in links, and the body's own C and LC,

    density = C / T * log(C * T / (LC * LT), base ln(C * LC / (C - LC) + LC_body * C / C_body + e)).

A node's sum is that of its children's densities. The node with the largest sum is where the text
is; the least density on its path up to the body is the threshold for its surroundings: while a
sibling of the chosen node reaches it, the choice widens to their parent. An <article> or <main>
around the chosen node ends the widening and is taken whole. Inside the choice, groups made of
links are left out, unless they are in an <article> or <main>.

Parts that say what they are (nav, aside, form, ... or a class, id or role from `BOILERPLATE`) hold
no article text and count as nothing. A form, button, dialog or object around an <article> or <main>,
and a form or button around the heading or most of the text, are plain containers. An <article> that
is named a comment is one, unless it holds the heading.

Cases: null, empty and tag-free pages give the text that is there, or an empty one; unclosed and
misnested tags are closed as browsers do for the common cases; equal pages give equal texts; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title nav aside footer form button select textarea input "
                   "iframe svg canvas object dialog menu audio video map".split())
HOLDING = frozenset("form button dialog object".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
           "th": {"table", "tr"}, "option": {"select"}}
WHOLE = frozenset(("article", "main"))
GROUPS = frozenset("ul ol dl menu div section table tbody tr".split())
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|banner)(?:$|[\s_-])", re.IGNORECASE)
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"header|topbar|footer|copyright|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing|social|widget|toolbar|pager|"
    r"pagination|search|skip|contentinfo|complementary)(?:$|[\s_-])", re.IGNORECASE)

COMMENT = re.compile(r"(?:^|\s)(?:(?:div-)?comments?(?:-(?:body|list|item|entry|content|text|wrapper|\d+))?|repl(?:y|ies))(?:$|\s)",
                     re.IGNORECASE)


#: Names are doubted where they leave less than this part of the text outside links; so many wrappers are undone.
LEFT = 8
WRAPPERS = 4


class Page(HTMLParser):
    """Nodes in page order (a parent before its children) and the text pieces with their nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.hard, self.hidden, self.soft = ["#root"], [0], [False], [False], [""]
        self.open = [0]
        self.n_open: Counter[str] = Counter()  # of each tag: an end tag without its start costs no walk
        self.pieces: list[tuple[int, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.pieces.append((-1, " "))
        if tag == "body" and "body" in self.tags or tag == "html" and len(self.tags) > 1:
            return
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SAME_LEVEL:
            self._close(SAME_LEVEL[tag], HOLDERS[tag])
        parent = self.open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.hard.append(tag in SILENT or tag == "header" and not self._in_whole(parent))
        self.hidden.append(self._hidden(attrs))
        self.soft.append("" if tag in ("html", "body", "main") else self._named(attrs, COMMENT if tag in WHOLE else BOILERPLATE))
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.pieces.append((-1, " "))
        self._close({tag}, set() if tag not in INLINE else {"td", "th", "table", "article", "main", "body"})

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data))

    def _close(self, tags: set[str], walls: set[str]) -> None:
        if not any(self.n_open[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tags[self.open[k]]
            if name in tags:
                self.n_open.subtract(self.tags[i] for i in self.open[k:])
                del self.open[k:]
                return
            if name in walls:
                return

    def _in_whole(self, at: int) -> bool:
        while at and self.tags[at] not in WHOLE:
            at = self.parents[at]
        return at > 0

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(n == "hidden" or n == "aria-hidden" and v == "true"
                   or n == "style" and v and re.search(r"display\s*:\s*none", v) for n, v in attrs)

    @staticmethod
    def _named(attrs: list[tuple[str, str | None]], names: re.Pattern) -> str:
        """The class, id or role that says boilerplate, if any does."""
        return next((v for n, v in attrs if n in ("class", "id", "role") and v and names.search(v)), "")

    def dropped(self) -> list[bool]:
        """Which nodes are boilerplate, by themselves or by a node above. A name is not believed of a node
        that holds an article not so named, nor of one with the page's heading unless it is called a header, nor
        of one that holds most of the text where the names would leave next to none of it."""
        n = len(self.tags)
        whole, heading = [False] * n, [t == "h1" for t in self.tags]
        for i in range(n - 1, 0, -1):
            whole[i] |= self.tags[i] in WHOLE and (not self.soft[i] or heading[i])
            whole[self.parents[i]] |= whole[i]
            heading[self.parents[i]] |= heading[i]
        named = [bool(self.soft[i] and not whole[i] and (not heading[i] or HEADER.search(self.soft[i]))) for i in range(n)]
        sure = [i > 0 and (self.hidden[i] or self.hard[i] and self.tags[i] not in HOLDING) for i in range(n)]
        if any(named):  # names that leave next to nothing are wrappers': the outermost one with most of the text is not believed
            text = self._text_of(sure)
            for _ in range(WRAPPERS):
                if LEFT * self._text_of([a or b for a, b in zip(named, sure)])[0] >= text[0]:
                    break
                wrapper = next((i for i in range(1, n) if named[i] and 2 * text[i] > text[0]), None)
                if wrapper is None:
                    break
                named[wrapper] = False
        out = [a or b for a, b in zip(named, sure)]
        holding = [i for i in range(1, n) if self.tags[i] in HOLDING and not out[i] and not whole[i]]
        if holding:
            text = self._text_of(out)
            for i in holding:
                out[i] = self.tags[i] not in ("form", "button") or not heading[i] and 2 * text[i] <= text[0]
        for i in range(1, n):
            out[i] |= out[self.parents[i]]
        return out

    def _text_of(self, out: list[bool]) -> list[int]:
        """The characters of each node outside links and outside the nodes of `out`."""
        n = len(self.tags)
        off, text = out[:], [0] * n
        for i in range(1, n):
            off[i] |= off[self.parents[i]] or self.tags[i] == "a"
        for at, t in self.pieces:
            if at >= 0 and not off[at]:
                text[at] += len("".join(t.split()))
        for i in range(n - 1, 0, -1):
            text[self.parents[i]] += text[i]
        return text


def _density(c: int, t: int, lc: int, lt: int, body_share: float) -> float:
    if not c:
        return 0.0
    t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
    return c / t * max(math.log(max(c / lc1 * t / lt, 1.0)) / base, 0.0)


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, white space and block borders as one space."""
    page = Page()
    page.feed(html or "")
    page.close()
    n = len(page.tags)
    tags, parents, dropped = page.tags, page.parents, page.dropped()
    chars, links, below, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
    for at, text in page.pieces:
        if at >= 0 and not dropped[at]:
            k = len("".join(text.split()))
            chars[at] += k
            links[at] += k * in_link[at]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if not dropped[i]:
            chars[p] += chars[i]
            links[p] += links[i]
            below[p] += below[i] + 1
            link_tags[p] += link_tags[i] + (tags[i] == "a")
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    share = links[body] / chars[body]
    density = [0.0 if dropped[i] else _density(chars[i], below[i], links[i], link_tags[i], share) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[parents[i]] += density[i]
    inside = [False] * n
    inside[body] = True
    for i in range(1, n):
        inside[i] = inside[i] or (i > body and inside[parents[i]] and not dropped[i])
    chosen = max((i for i in range(n) if inside[i]), key=lambda i: (sums[i], -i))

    path = [chosen]
    while path[-1] != body:
        path.append(parents[path[-1]])
    threshold = min(density[i] for i in path)
    whole = next((i for i in path if tags[i] in WHOLE), None)
    if whole is not None:
        chosen = whole
    else:
        siblings: dict[int, list[int]] = {}
        for i in range(1, n):
            if inside[i] and i != body:
                siblings.setdefault(parents[i], []).append(i)
        for i in path[:-1]:
            if i == chosen and any(k != i and density[k] >= threshold and density[k] > 0 for k in siblings[parents[i]]):
                chosen = parents[i]
    taken, in_whole = [False] * n, [False] * n
    taken[chosen] = True
    for i in range(1, n):
        in_whole[i] = in_whole[parents[i]] or tags[i] in WHOLE
    for i in range(chosen + 1, n):
        of_links = tags[i] in GROUPS and links[i] > 0.8 * chars[i] and link_tags[i] > 2 and not in_whole[i]
        taken[i] = taken[parents[i]] and not dropped[i] and not of_links
    return " ".join("".join([t for at, t in page.pieces if at < 0 or taken[at]]).split())


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages without the column `html`, with the main text and its length in code points (n_chars)."""
    kept = [c for c in pages.columns if c not in (html, out, "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema.fields]
                       + [f"`{out}` string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            own = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*kept, out, "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)
