"""HTML main text by composite text density.

A page is read into a list of nodes.  Elements that are not part of an article
by their kind (menus, headers, footers, sidebars, forms, scripts, styles) or that
are hidden are left out.  So are those that a word of their class, id or role
marks (adverts, notices, comments and so on), unless the word stands on a
wrapper of the main text (``Page._wraps``): the densities decide there.
For every remaining node with C characters, T tags, LC characters and LT tags
in links the composite density is

    C / T * log base ln(C * LC / (C - LC) + LCb * C / Cb + e) of (C * T / (LC * LT))

with b for the body and zero divisors as one.  The block whose child blocks'
densities sum to the maximum holds the main text (inline elements are part of
their block's text, not candidates).  The blocks on its path to the body give a
threshold, the least density on that path.  An ``article`` or ``main`` that
encloses the block is the main text; without one it is the block and, of the
other children of the blocks on its path, those that reach the threshold.

Defined results: a null, empty or tagless page gives its plain text (or an
empty one); unclosed elements end with their parent; character references are
decoded; a head without its end tag ends at ``<body>`` or at the first text or
element that may not stand in one; white space in a block is one space and blocks are joined by one
space.  Rows are handled one by one, repeated ones alike; other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
ATTR = re.compile(r"(?P<name>[a-zA-Z-]+)\s*+(?:=\s*+(?:\"(?P<a>[^\"]*+)\"|'(?P<b>[^']*+)'|(?P<c>[^\s>]++)))?")

# fixed HTML element names
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("head nav header footer aside form button select fieldset dialog menu object canvas audio video applet".split())
ENDS_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("article main body section div table ul ol dl td th blockquote".split())
# words of class, id and role attributes that mark what is not the article
NOISE = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side
 menu navbar nav navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal
 newsletter subscribe subscription signup paywall comment comments reply replies disqus respond discussion related recommended share sharing
 social pagination pager toolbar widget complementary contentinfo""".split())
# next to nothing is what the rest holds more than so many times
NEARLY_ALL = 9


class Page:
    """Nodes of a page: tag, parent, own text parts, and the counts."""

    def __init__(self, source: str):
        self.tags, self.parent, self.parts = ["body"], [-1], [[]]
        self.chars, self.link_chars, self.n_tags, self.link_tags = [0], [0], [1], [0]
        self.kids: list[list[int]] = [[]]
        self.order: list[tuple[int, str]] = []       # (node, text) in page order; text "" for a block's edge
        self.marked = [False]
        self._read(source)
        if any(self.marked):
            self._leave_out()
        for i in range(len(self.tags) - 1, 0, -1):
            p = self.parent[i]
            for a in (self.chars, self.link_chars, self.n_tags, self.link_tags):
                a[p] += a[i]

    def _leave_out(self) -> None:
        """Empty the marked nodes that are no wrappers, with all in them."""
        n = len(self.tags)
        plain = [c - l for c, l in zip(self.chars, self.link_chars)]     # unlinked characters: of the whole subtree
        bare, holds = list(plain), [False] * n                           # the same outside marked nodes; holds an article or main
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            plain[p] += plain[i]
            bare[p] += 0 if self.marked[i] else bare[i]
            holds[p] |= holds[i] or self.tags[i] in ("article", "main")
        out, scope = [False] * n, [0] * n                                # scope: the nearest article, main or body around a node
        for i in range(1, n):
            p = self.parent[i]
            scope[i] = p if self.tags[p] in ("article", "main") else scope[p]
            out[i] = out[p] or (self.marked[i] and not self._wraps(i, scope[i], plain, bare, holds))
            if out[i]:
                self.chars[i] = self.link_chars[i] = self.n_tags[i] = self.link_tags[i] = 0
        self.kids = [[k for k in kids if not out[k]] for kids in self.kids]
        self.order = [x for x in self.order if not out[x[0]]]

    def _wraps(self, i: int, scope: int, plain: list, bare: list, holds: list) -> bool:
        """Whether a marked node is a wrapper of the main text.  It is one if it
        holds an article or main, at least as many unlinked characters as what
        is not marked around it, and not next to nothing of all; or if, on a
        page without article and main, it holds most of the unlinked
        characters; or if next to nothing is left without it."""
        rest = plain[scope] - plain[i]
        if holds[i] and self.tags[scope] != "article":
            return plain[i] >= bare[scope] and rest <= NEARLY_ALL * plain[i]
        return plain[i] > (NEARLY_ALL if holds[0] else 1) * rest

    def _read(self, source: str) -> None:
        stack, skip = [(0, "body", False)], None          # (node, tag, in a link); skip: depth below which nothing counts
        for m in TOKEN.finditer(source):
            text = m["text"] if m["text"] is not None else m["cdata"]
            if skip is not None and stack[-1][1] == "head" and self._ends_head(m):
                skip = self._close(stack, "head", skip)
            if text is not None:
                if skip is None:
                    node, _, link = stack[-1]
                    text = html.unescape(text) if "&" in text and m["cdata"] is None else text
                    n = len("".join(text.split()))
                    self.order.append((node, text))
                    self.chars[node] += n
                    if link:
                        self.link_chars[node] += n
                continue
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if tag in ("html", "body"):
                continue
            block = tag not in INLINE
            if block and skip is None:
                self.order.append((stack[-1][0], ""))
            if m["end"]:
                skip = self._close(stack, tag, skip)
                if block and skip is None:
                    self.order.append((stack[-1][0], ""))
                continue
            if tag in ENDS_P:
                skip = self._imply(stack, {"p"}, skip)
            if tag in SIBLINGS:
                skip = self._imply(stack, SIBLINGS[tag], skip)
            if tag in VOID:
                continue
            marked, hidden = (False, False) if skip is not None or tag in SKIP or tag in ("article", "main") else self._noise(m["attrs"])
            out = skip is None and (tag in SKIP or hidden)
            if skip is None and not out:
                p, _, link = stack[-1]
                link = link or tag == "a"
                self.tags.append(tag)
                self.parent.append(p)
                self.marked.append(marked)
                self.kids.append([])
                self.kids[p].append(len(self.tags) - 1)
                self.chars.append(0)
                self.link_chars.append(0)
                self.n_tags.append(1)
                self.link_tags.append(int(link))
                stack.append((len(self.tags) - 1, tag, link))
                self.order.append((stack[-1][0], "")) if block else None
            else:
                stack.append((stack[-1][0], tag, stack[-1][2]))
                if out:
                    skip = len(stack) - 1

    @staticmethod
    def _ends_head(m: re.Match) -> bool:
        """Whether a token that may not stand in a head ends an open one."""
        if m["text"] is not None:
            return bool(m["text"].strip())
        tag = (m["raw"] or m["tag"] or "").lower()
        if m["end"]:
            return tag in ("html", "body")
        return tag not in ("", "html", "head") and tag not in IN_HEAD

    @staticmethod
    def _close(stack: list, tag: str, skip: int | None) -> int | None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] == tag:
                del stack[k:]
                return None if skip is not None and skip >= k else skip
        return skip

    def _imply(self, stack: list, tags: set, skip: int | None) -> int | None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in tags:
                return self._close(stack, stack[k][1], skip)
            if stack[k][1] in HOLDS:
                break
        return skip

    @staticmethod
    def _noise(attrs: str) -> tuple[bool, bool]:
        """Whether a word marks an element, and whether it is hidden."""
        marked = False
        if not attrs or attrs == "/":
            return False, False
        for a in ATTR.finditer(attrs):
            name, value = a["name"].lower(), (a["a"] or a["b"] or a["c"] or "").lower()
            if name in ("class", "id", "role") and not NOISE.isdisjoint(re.split(r"[^a-z]+", value)):
                marked = True
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return marked, True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return marked, True
        return marked, False

    def density(self, i: int) -> float:
        c, t, lc, lt = self.chars[i], self.n_tags[i], self.link_chars[i], self.link_tags[i]
        if not c:
            return 0.0
        base = math.log(c * lc / max(1, c - lc) + self.link_chars[0] * c / max(1, self.chars[0]) + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(max(base, 1.0001)) if base > 1 else c / t * math.log(
            max(1.0, c / max(1, lc) * t / max(1, lt)) + 1)

    def main(self) -> set[int]:
        """The nodes whose subtrees hold the main text."""
        dens = [self.density(i) for i in range(len(self.tags))]
        block = [t not in INLINE for t in self.tags]
        sums = [sum(dens[k] for k in kids if block[k]) if block[i] else 0.0 for i, kids in enumerate(self.kids)]
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        path = [best]
        while path[-1] > 0:
            path.append(self.parent[path[-1]])
        for i in path:
            if self.tags[i] in ("article", "main"):
                return {i}
        least = min(dens[i] for i in path)
        return {best, *(k for i in path[1:] for k in self.kids[i] if k not in path and self.chars[k] and dens[k] >= least)}


def main_text(source: str) -> str:
    page = Page(source)
    tops = page.main()
    inside = [i in tops for i in range(len(page.tags))]
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parent[i]]
    return " ".join("".join(t or " " for i, t in page.order if inside[i]).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                      F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string()),
                                              pa.array([len(t) for t in texts], type=pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
