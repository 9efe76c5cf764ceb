"""Main text of web pages by composite text density.

A page is parsed into a tree. Elements that are never article text (menus, headers, footers, sidebars, forms, scripts,
styles, and by role or name notices and reader comments) are left out. Elements whose class or id only hints at such a
part are left out while the article is looked for, unless nothing else has text. Of every other node the density is its
characters per tag, lowered by its share of link text:

    C/T * log(C/L * T/A) / log(e + C_L/C * ... )       C characters, T tags, L link characters, A link tags

A node's sum is that of its children's densities, its own direct text taken as a child. The node with the largest
sum is chosen. The lowest density on the path from it to the body is the threshold: the choice moves up as long as
the parent isn't the body and all of its children that have text reach the threshold, and to an enclosing article.
Text of the chosen subtree is kept, in page order. Inside it a name hints at more than it proves ("share-price",
"form-list"), so of those elements only containers go, whose name says nothing else than such a part and whose own sum of
densities is under a quarter of the article's.

Time is linear in the length of the page: open elements are looked up by name.

Defined cases: null or empty html gives an empty text; text without any tag is a body's own text; null ids and urls
stay; repeated rows give repeated results; an empty table gives none; other columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import map_arrow, text_or_empty

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav header footer aside form script style title textarea noscript template iframe embed button select option dialog menu head xmp noembed noframes datalist".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Parts of class names and ids that mark what isn't article text; readers' comments apart.
NOT_TEXT = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations toolbar widget pagination pager copyright disclaimer alert form search skip".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
# Parts of names that say only what an element holds or where it is; and elements that hold others.
NEUTRAL = frozenset("area block body box container content group holder inner list main outer panel section slot top bottom unit widget wrap wrapper".split())
CONTAINERS = frozenset("article details div dl ol section ul".split())
BOXES = frozenset("article details div section".split())


class Page:
    """Nodes in page order: tag, parent, whether it is left out; and runs of text with their node. ``hinted`` has the
    nodes whose name or style hints that they aren't article text, with whether the name says nothing else."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.texts = ["body"], [-1], [False], []
        self.hinted: dict[int, bool] = {}
        #: Depths of the open elements, by name; and of those that aren't inline.
        self.open, self.blocks = defaultdict(list), []
        self._parse(html)
        holders: set[int] = set()
        for i, t in enumerate(self.tag):
            while t in ("article", "main", "h1") and i >= 0 and i not in holders:
                holders.add(i)
                i = self.parent[i]
        for i in holders:  # a wrapper around the article is no sidebar, whatever its name
            self.hinted.pop(i, None)

    def _kind(self, tag: str, attributes: str) -> tuple[bool, bool | None]:
        """Whether an element is left out, and else the hint of its name (None without one)."""
        if tag in NEVER:
            return tag != "header" or not self.open["article"], None  # an article may have a heading of its own
        if not attributes:
            return False, None
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        if found.get("role", "").lower() in ROLES:
            return True, None
        names = [[p.lower() for p in NAME_PART.findall(x)] for x in f"{found.get('class', '')} {found.get('id', '')}".split()]
        pure = [set(n) for n in names if n]
        if tag in CONTAINERS and any(n & COMMENTS and n <= COMMENTS | NEUTRAL for n in pure):
            return True, None
        if tag in ("body", "html", "article", "main"):
            return False, None
        hidden = re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes) or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""))
        hints = NOT_TEXT | COMMENTS
        if hidden or any(n & hints for n in pure):
            return False, tag in BOXES and any(n & hints and n <= hints | NEUTRAL for n in pure)
        return False, None

    def _push(self, node: int, stack: list[int]) -> None:
        self.open[self.tag[node]].append(len(stack))
        if self.tag[node] not in INLINE:
            self.blocks.append(len(stack))
        stack.append(node)

    def _cut(self, depth: int, stack: list[int]) -> None:
        """End the open elements from ``depth`` on."""
        while len(stack) > depth:
            tag = self.tag[stack.pop()]
            self.open[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def _innermost(self, tags) -> int:
        """The depth of the innermost open element of ``tags``; 0 without one."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def _close(self, stack: list[int], tags, stops) -> None:
        """End the innermost open element of ``tags``, unless one of ``stops`` is further in."""
        depth = self._innermost(tags)
        if depth > self._innermost(stops):
            self._cut(depth, stack)

    def _parse(self, html: str) -> None:
        at, n, stack, texts = 0, len(html), [0], self.texts
        while at < n:
            start = html.find("<", at)
            if start < 0:
                start = n
            if start > at:
                texts.append((stack[-1], html[at:start]))
            if start == n:
                return
            m = TAG.match(html, start)
            if not m:
                at = self._other(html, start, stack)
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._end(tag, stack)
            else:
                at = self._start(html, tag, m[3], at, stack)

    def _other(self, html: str, start: int, stack: list[int]) -> int:
        """A comment, a declaration, a tag that doesn't end well, or a mere < in the text."""
        if html.startswith("<!--", start):
            if html.startswith((">", "->"), start + 4):
                return html.index(">", start) + 1
            end = html.find("-->", start + 4)
            return end + 3 if end >= 0 else len(html)
        if html[start + 1 : start + 2] in ("!", "?") or re.match(r"</?[a-zA-Z]", html[start : start + 3]):
            end = html.find(">", start)
            return end + 1 if end >= 0 else len(html)
        self.texts.append((stack[-1], "<"))
        return start + 1

    def _end(self, tag: str, stack: list[int]) -> None:
        if tag in ("body", "html"):
            return
        if tag == "p" or tag not in INLINE:
            self.texts.append((stack[-1], " "))
        depth = self._innermost((tag,))
        if not depth or tag in INLINE and self.blocks and self.blocks[-1] > depth or tag in ("p", "li", "span") and self._innermost(("article", "main", "table", "td", "th")) > depth:
            return
        self._cut(depth, stack)

    def _start(self, html: str, tag: str, attributes: str, at: int, stack: list[int]) -> int:
        if tag in ("html", "body"):
            return at
        if tag in ENDS_P:
            self._close(stack, ("p",), ("table", "td", "th", "button", "div", "section", "article", "main", "li", "blockquote", "body"))
        if tag in ENDS_SAME:
            ends, stops = ENDS_SAME[tag]
            self._close(stack, ends.split(), stops.split())
        if tag in ("article", "main") and self.tag[stack[-1]] in ("nav", "ul", "ol", "li", "a"):
            self._close(stack, ("nav",), ())  # a menu that was never closed
        if tag not in INLINE:
            self.texts.append((stack[-1], " "))
        if tag in VOID:
            return at
        out, hint = self._kind(tag, attributes)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.out.append(out)
        node = len(self.tag) - 1
        if hint is not None:
            self.hinted[node] = hint
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if not end:
                return len(html)
            close = html.find(">", end.end())
            return close + 1 if close >= 0 else len(html)
        if not attributes.endswith("/") or tag not in ("svg", "path", "circle"):
            self._push(node, stack)
        return at


def _inside(page: Page, top: int) -> list[bool]:
    """Whether each node is ``top`` or below it."""
    found = [False] * len(page.tag)
    found[top] = True
    for i in range(top + 1, len(found)):
        found[i] = found[page.parent[i]]
    return found


class Densities:
    """Characters, densities and their sums of the nodes that aren't in ``out``."""

    def __init__(self, page: Page, out: list[bool]):
        tag, parent, n = page.tag, page.parent, len(page.tag)
        self.out, link = list(out), [False] * n
        for i in range(1, n):
            self.out[i] = self.out[i] or self.out[parent[i]]
            link[i] = tag[i] == "a" or link[parent[i]]
        out, own = self.out, [0] * n
        for i, t in page.texts:
            if t != " " and not out[i]:
                own[i] += len("".join(t.split()))
        chars, tags = own[:], [1] * n
        links, anchors = [own[i] if link[i] else 0 for i in range(n)], [int(tag[i] == "a") for i in range(n)]
        for i in range(n - 1, 0, -1):
            if not out[i]:
                p = parent[i]
                chars[p] += chars[i]
                tags[p] += tags[i]
                links[p] += links[i]
                anchors[p] += anchors[i]
        self.chars, whole, whole_links = chars, max(1, chars[0]), links[0]

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            base = log(c / max(1, c - lc) * lc + whole_links / whole * c + e)
            return c / t * log(max(1.0, c / max(1, lc) * t / max(1, lt)) + e - 1) / max(1.0, base)

        self.dense = [0.0 if out[i] else density(chars[i], tags[i], links[i], anchors[i]) for i in range(n)]
        self.sums = [0.0 if out[i] or not own[i] else density(own[i], 1, own[i] if link[i] else 0, int(link[i])) for i in range(n)]
        for i in range(1, n):
            self.sums[parent[i]] += self.dense[i]

    def choose(self, page: Page) -> int:
        """The node with the largest sum, moved up as the module text says."""
        tag, parent, dense = page.tag, page.parent, self.dense
        best = max(range(len(tag)), key=lambda i: (self.sums[i], -i))
        path = [best]
        while path[-1] > 0:
            path.append(parent[path[-1]])
        threshold = min(dense[i] for i in path)
        least = [float("inf")] * len(tag)  # the lowest density of the children that have text
        for i in range(1, len(tag)):
            if not self.out[i] and self.chars[i]:
                least[parent[i]] = min(least[parent[i]], dense[i])
        for p in path[1:-1]:
            if least[p] < threshold:
                break
            best = p
        for p in path:
            if tag[p] in ("article", "main"):
                return min(best, p)
        return best


def main_text(html: str) -> str:
    """The article's text: one space between words, character references decoded."""
    if not html:
        return ""
    page = Page(html)
    page.texts = [(i, unescape(t) if "&" in t else t) for i, t in page.texts]
    found = Densities(page, [o or i in page.hinted for i, o in enumerate(page.out)])
    if not found.chars[0]:
        found = Densities(page, page.out)
    if not found.chars[0]:
        return ""
    best = found.choose(page)
    inside = _inside(page, best)
    out = list(page.out)
    if any(pure and inside[i] for i, pure in page.hinted.items()):
        whole = Densities(page, page.out)
        for i, pure in page.hinted.items():
            out[i] = out[i] or pure and inside[i] and i != best and whole.sums[i] < whole.sums[best] / 4
    for i in range(best + 1, len(out)):
        out[i] = out[i] or out[page.parent[i]]
    return " ".join("".join(t for i, t in page.texts if inside[i] and not out[i]).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")), run, "page_id long, url string, text string, n_chars long")
