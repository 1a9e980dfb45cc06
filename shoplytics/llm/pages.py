"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with two states, main text or not.  Node potentials
come from its tag, class and id words, role, how much of its text is links, and
how long it is; edge potentials connect parent and child, one table for boxes (div,
section, form ...) and one for blocks that follow the box around them (p, h2, li ...).  Sum-product messages go up
from the leaves and down from the root, once each, which is exact on a tree;
a text run is kept if the marginal of its block says main text.

Potentials are log ratios counted on labelled pages (``labelled_pages``), smoothed and
bounded; training takes milliseconds and runs on the driver.

Text: character references are decoded; white space in a block becomes one space; inline
elements belong to the block around them; blocks are joined in page order by one
space.  Scripts, styles, comments, form controls and the head are not text.

Defined cases: null or empty html gives an empty text, 0 characters; a page that is cut off, not
closed, or no html at all is read as far as it goes; deep nesting needs no
recursion; rows that repeat give the same text; null page_id and url stay null; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import pick
from shoplytics.llm.labelled_pages import PAGES

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:[^><\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style title noscript template iframe object svg math select textarea button audio video canvas".split())
#: Elements that can stand in the head; any other ends it.
HEAD = frozenset("base link meta title script style noscript template html head".split())
#: Elements that make a block of their own.
BLOCKS = frozenset("""html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table
thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend label details summary address center hgroup menu search dialog""".split())
#: Blocks that hold a part of a page, of whatever sort; the others follow the block around them.
BOXES = frozenset("html body main article section header footer nav aside div form fieldset dialog menu search".split())
_RAW = {t: re.compile(rf"</{t}(?![a-zA-Z])[^>]*>?", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}
#: An open block that an opening tag ends first.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = frozenset("ul ol menu dl table".split())


_SAME = {t: re.compile(rf"<(/?){t}(?![a-zA-Z])", re.I) for t in DROPPED - _RAW.keys()}


def _with_end(page: str, tag: str) -> set[int]:
    """Where the opening tags of an element stand that have a closing tag of their own."""
    open_, out = [], set()
    for m in _SAME[tag].finditer(page):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            out.add(open_.pop())
    return out


class Dom:
    """Blocks in page order (parents first) and the runs of text with their blocks."""

    def __init__(self, page: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.runs: list[tuple[int, list[str]]] = []  # block, pieces of text
        self.chars, self.link_chars = [0], [0]
        stack, dropped, in_link = [0], 0, False
        loose = in_head = False  # in a dropped element without an end; in the head
        ended: dict[str, set[int]] = {}
        pos, end = 0, len(page)
        fresh = True  # the next text begins a run
        open_: Counter = Counter()  # open blocks by tag
        while pos < end:
            m = _TAG.search(page, pos)
            stop = m.start() if m else end
            text = page[pos:stop] if stop > pos and not dropped else ""
            if in_head and text.strip():
                in_head = False
            if text and not in_head:
                if "&" in text:
                    text = html.unescape(text)
                if fresh or self.runs[-1][0] != stack[-1]:
                    self.runs.append((stack[-1], []))
                    fresh = False
                self.runs[-1][1].append(text)
                n = len(text.strip())
                self.chars[stack[-1]] += n
                if in_link:
                    self.link_chars[stack[-1]] += n
            if not m:
                break
            pos = m.end()
            if m.group(2) is None:
                continue
            tag, closing = m.group(2).lower(), m.group(1) == "/"
            if tag == "head":
                in_head = not closing
                continue
            in_head = in_head and tag in HEAD
            if dropped and loose and (tag in BLOCKS or tag in DROPPED):
                dropped, loose = 0, False  # no end was there: the next block ends it
            if tag in DROPPED:
                if tag in _RAW and not closing:
                    close = _RAW[tag].search(page, pos)
                    pos = close.end() if close else end
                elif closing:
                    dropped = max(0, dropped - 1)
                elif not m.group(3).rstrip().endswith("/"):
                    if tag not in ended:
                        ended[tag] = _with_end(page, tag)
                    loose = loose if dropped else m.start() not in ended[tag]
                    dropped += 1
                continue
            if dropped:
                continue
            if tag in ("br", "hr"):
                if self.runs and not fresh:
                    self.runs[-1][1].append(" ")
            elif tag == "a":
                in_link = not closing
            elif tag in BLOCKS:
                fresh, in_link = True, False
                if closing:
                    if open_[tag]:
                        while self.tag[stack[-1]] != tag:
                            open_[self.tag[stack.pop()]] -= 1
                        open_[self.tag[stack.pop()]] -= 1
                    continue
                if self.tag[stack[-1]] == "p":
                    open_[self.tag[stack.pop()]] -= 1
                ends = _ENDS.get(tag, ())
                if any(open_[t] for t in ends):
                    i = len(stack) - 1
                    while self.tag[stack[i]] not in ends and self.tag[stack[i]] not in _HOLDS:
                        i -= 1
                    if self.tag[stack[i]] in ends:
                        for node in stack[i:]:
                            open_[self.tag[node]] -= 1
                        del stack[i:]
                open_[tag] += 1
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.attrs.append(m.group(3))
                self.chars.append(0)
                self.link_chars.append(0)
                stack.append(len(self.tag) - 1)

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        chars, links = self.chars[:], self.link_chars[:]
        for i in range(n - 1, 0, -1):  # text below a node counts for it
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]
        out = []
        for i in range(n):
            f = [f"tag:{self.tag[i]}"]
            if self.attrs[i]:
                for name, *values in _ATTR.findall(self.attrs[i]):
                    if (name := name.lower()) in ("class", "id", "role"):
                        f += {f"name:{w}" for v in values for w in _NAME.findall(v.lower())}
            if chars[i]:
                share = links[i] / chars[i]
                f.append(f"links:{0 if share < 0.1 else 1 if share < 0.5 else 2}")
                f.append(f"length:{min(3, int(math.log10(chars[i])))}")
            out.append(f)
        return out


class Model:
    """Potentials: a weight per feature, and the log ratios of the edges."""

    #: Bounds of a feature's weight, by its kind: how it looks says less than what it is called.
    BOUND = {"tag": 4.0, "name": 4.0, "links": 1.5, "length": 0.5}

    def __init__(self, pages: list[str]):
        seen, states = (Counter(), Counter()), [0, 0]
        edges = [[[0.5, 0.5], [0.5, 0.5]] for _ in (0, 1)]  # by whether the child is a box
        for page in pages:
            dom = Dom(page)
            y = []
            for i, attrs in enumerate(dom.attrs):
                own = re.search(r'data-y="([01])"', attrs)
                y.append(int(own[1]) if own else y[dom.parent[i]] if i else 0)
            for i, features in enumerate(dom.features()):
                seen[y[i]].update(features)
                states[y[i]] += 1
                if i:
                    edges[dom.tag[i] in BOXES][y[dom.parent[i]]][y[i]] += 1
        self.weight = {}
        for f in seen[0].keys() | seen[1].keys():
            w = math.log((seen[1][f] + 0.02) / (states[1] + 0.04)) - math.log((seen[0][f] + 0.02) / (states[0] + 0.04))
            bound = self.BOUND[f.split(":")[0]]
            self.weight[f] = max(-bound, min(bound, w))
        #: edge[child is a box][parent state][child state]: the child's state given its parent's.
        self.edge = [[[n / sum(row) for n in row] for row in kind] for kind in edges]

    def marginals(self, dom: Dom) -> list[float]:
        """P(main text) of each node: messages up, then down."""
        n = len(dom.tag)
        edge = [self.edge[t in BOXES] for t in dom.tag]
        own = [math.exp(max(-8.0, min(8.0, sum(self.weight.get(x, 0.0) for x in f)))) for f in dom.features()]
        # up: (weight of state 0, of state 1) of a node with all that is below it; to: its message to the parent.
        up0, up1, to0, to1 = [1.0] * n, own, [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            s = up0[i] + up1[i]
            a, b = up0[i] / s, up1[i] / s
            up0[i], up1[i] = a, b
            e0, e1 = edge[i]
            m0, m1 = e0[0] * a + e0[1] * b, e1[0] * a + e1[1] * b
            to0[i], to1[i] = m0, m1
            p = dom.parent[i]
            x, y = up0[p] * m0, up1[p] * m1
            s = x + y
            up0[p], up1[p] = x / s, y / s
        at = [0.0] * n
        at[0] = up1[0] / (up0[0] + up1[0])
        for i in range(1, n):
            p = at[dom.parent[i]]
            e0, e1 = edge[i]
            # What the parent believes without this child's message.
            c0, c1 = (1 - p) / max(to0[i], 1e-300), p / max(to1[i], 1e-300)
            s = c0 + c1
            c0, c1 = c0 / s, c1 / s
            a, b = up0[i] * (c0 * e0[0] + c1 * e1[0]), up1[i] * (c0 * e0[1] + c1 * e1[1])
            at[i] = b / (a + b) if a + b else 0.5
        return at

    def text(self, page: str | None) -> str:
        if not isinstance(page, str) or not page:
            return ""
        dom = Dom(page)
        at = self.marginals(dom)
        blocks = (" ".join("".join(pieces).split()) for node, pieces in dom.runs if at[node] > 0.5)
        return " ".join(b for b in blocks if b)


@functools.cache
def trained() -> Model:
    return Model(PAGES)


def _main_text(pages: pd.Series) -> pd.Series:
    model = trained()
    return pd.Series([model.text(p) for p in pages], dtype=object)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    read = F.pandas_udf(_main_text, "string")
    p = pick(pages, "page_id", "url", "html").select("page_id", "url", read("html").alias("text"))
    return p.withColumn("n_chars", F.length("text").cast("long"))
