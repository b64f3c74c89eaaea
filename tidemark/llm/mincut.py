"""Main text of HTML pages as a minimum cut.

A page becomes a row of text blocks.  A logistic classifier, fitted on made-up
labelled pages (`pagemaker`), gives each block the log-odds of being content
from its surroundings and text; these are the capacities to the two terminals.
Blocks next to each other, and blocks with the same parent, are joined by
edges whose capacity is the cost of separating them, fitted on the same pages.
The maximum flow's cut labels the blocks, so a block whose own looks tell
little goes with its neighbours.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slabs, texts_of
from .pagemaker import page as made_page

#: A tag with its attributes up to its end; nothing is tried twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is never text of the page; raw ones end only at their own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"}
SILENT = {"head", "template", "svg", "math", "object", "canvas", "select", "button", "audio", "video", "map", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What elements, class names and roles say about what they hold.
GOOD_TAGS, BAD_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
GOOD_NAMES = set("content article post entry story body main text".split())
BAD_NAMES = set("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup sidebar side rail widget widgets related recommended share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar pagination pager comment comments reply replies respond disqus discussion login search copyright legal skip tags taglist outbrain taboola alert".split())
GOOD_ROLES, BAD_ROLES = {"main", "article"}, {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
#: Class names that speak of the layout, as in has-sidebar, and say nothing of what the element holds.
LAYOUT = re.compile(r"(?:with|has|no|without|show|hide)[-_]\S*")
HEADINGS, PROSE = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "pre", "blockquote", "td", "dd", "figcaption"}
#: Shares of the edges' scale: neighbours with one parent, with two, and blocks with one parent and others between.
SIBLINGS, ADJACENT, SAME_PARENT = 1.0, 0.4, 0.5
SCALES = (0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)
#: Log-odds are cut off here, so that no word list outweighs all neighbours of a block.
MOST = 4.0
FIT_PAGES, RIDGE = 400, 3.0
WORD = re.compile(r"\w[\w'’-]*")
#: Words from which on a block's length tells no more.
ENOUGH = 150


def surroundings(tag: str, attributes: str, inside_article: bool) -> tuple[int, int, bool]:
    """(how good, how bad an element's own markup is: 0, 1 by a name, 2 by an element or role; whether it is hidden)."""
    good, bad = 2 * (tag in GOOD_TAGS), 2 * (tag in BAD_TAGS or (tag == "header" and not inside_article))
    hidden = False
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            found = {w for w in re.split(r"[^a-z]+", LAYOUT.sub(" ", value))}
            if found & BAD_NAMES and tag not in ("body", "html", "main"):
                bad = max(bad, 1)
            elif found & GOOD_NAMES:
                good = max(good, 1)
        elif name == "role":
            good, bad = max(good, 2 * (value in GOOD_ROLES)), max(bad, 2 * (value in BAD_ROLES))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return good, bad, hidden


@lru_cache(maxsize=32)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def pieces_of(page: str):
    """Text (as one string) and tags (closing, name, attributes) in one pass over the page; a tag without an end takes the rest of the page along."""
    at, size, loose = 0, len(page), False
    while at < size:
        i = page.find("<", at)
        if i < 0:
            yield page[at:]
            return
        if i > at:
            yield page[at:i]
        head = NAME.match(page, i)
        if head:
            m = None if loose else TAG.match(page, i)
            if m:
                closing, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
            else:
                loose = True  # from here on quotes are not trusted, so no stretch is read twice
                end = page.find(">", head.end())
                if end < 0:
                    return
                closing, tag, attributes, at = head[1], head[2].lower(), page[head.end() : end], end + 1
            yield closing, tag, attributes
            if not closing and tag in RAW:
                end = _end_of(tag).search(page, at)
                end = page.find(">", end.end()) if end else -1
                if end < 0:
                    return
                at = end + 1
            continue
        mark = page[i + 1 : i + 2]
        if mark not in ("!", "?") or not mark:
            yield "<"
            at = i + 1
            continue
        start, close = ("<!--", "-->") if page.startswith("<!--", i) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", i) else ("<!", ">")
        end = page.find(close, i + len(start))
        if start == "<![CDATA[":
            yield page[i + 9 : end if end >= 0 else size]
        if end < 0:
            return
        at = end + len(close)


class Block:
    """A text block: its text, innermost block tag, number of the parent element, what surrounds it, and its share of linked characters."""

    __slots__ = ("around", "linked", "parent", "tag", "text")

    def __init__(self, text: str, tag: str, parent: int, around: tuple[int, int, int], linked: float):
        self.text, self.tag, self.parent, self.around, self.linked = text, tag, parent, around, linked


def blocks_of(page: str) -> list[Block]:
    """The blocks in page order; every step is constant work but for what it opens, closes or says."""
    out: list[Block] = []
    # open elements: tag, (good, bad inside it, bad outside it), hidden, in an article, number, linked
    stack: list[tuple[str, tuple[int, int, int], bool, bool, int, bool]] = [("", (0, 0, 0), False, False, 0, False)]
    where: dict[str, list[int]] = {}  # positions of open elements by tag
    blocks, others = [0], [0]  # positions of open blocks, and of those that are no paragraphs
    parts: list[str] = []
    linked = serial = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                own = blocks[-1]
                out.append(Block(text, stack[own][0], stack[max(0, own - 1)][4], stack[-1][1], min(1.0, linked / len(text))))
        linked = 0

    def close(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop()[0]
            where[tag].pop()
            if tag in BLOCK:
                blocks.pop()
                if tag != "p":
                    others.pop()

    for piece in pieces_of(page):
        if isinstance(piece, str):
            if not stack[-1][2]:
                parts.append(piece)
                if stack[-1][5]:
                    linked += len(piece)
            continue
        closing, tag, attributes = piece
        open_ = where.setdefault(tag, [])
        if closing:
            if tag in BLOCK:
                flush()
            # an inline end tag closes nothing outside its block
            if open_ and (tag in BLOCK or open_[-1] > blocks[-1]):
                close(open_[-1])
            continue
        if tag in BLOCK:
            flush()
            for name in ("p",) if tag not in ("li", "dd", "dt", "tr", "td", "th", "option") else ("p", tag):
                at = where.get(name)
                if at and at[-1] >= others[-1]:
                    close(at[-1])
        if tag in ("br", "img", "input"):
            parts.append(" ")
        if tag in RAW or tag in VOID or attributes.rstrip().endswith("/"):
            continue
        _, (good, inner, outer), hidden, in_article, _, link = stack[-1]
        is_good, is_bad, gone = surroundings(tag, attributes, in_article)
        if is_bad:
            inner = max(inner, is_bad)
        elif is_good:
            good, inner, outer = max(good, is_good), 0, max(outer, inner)
        serial += 1
        open_.append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
            if tag != "p":
                others.append(len(stack))
        stack.append((tag, (good, inner, outer), hidden or gone or tag in SILENT, in_article or tag in GOOD_TAGS, serial, link or tag == "a"))
    flush()
    return out


def features(b: Block) -> list[float]:
    """What the classifier sees of a block; its whole text counts, up to where more words tell no more."""
    n = sum(1 for _ in islice(WORD.finditer(b.text), ENOUGH))
    good, inner, outer = b.around
    low = b.text.lower()
    mark = "©" in low or "all rights reserved" in low
    return [1.0, good == 1, good == 2, inner == 1, inner == 2, outer == 1, outer == 2, math.log1p(n), n < 5, b.linked, b.tag in HEADINGS, b.tag in PROSE, b.tag == "li", b.text[-1] in ".!?…:;\"'»)”", mark / (1 + n / 20)]


class Model:
    """Weights of the classifier and the scale of the edges."""

    def __init__(self, weights: np.ndarray, scale: float):
        self.weights, self.scale = weights, scale

    def gain(self, blocks: list[Block]) -> list[float]:
        return np.clip(np.array([features(b) for b in blocks], np.float64) @ self.weights, -MOST, MOST).tolist()

    def labels(self, blocks: list[Block]) -> list[bool]:
        return min_cut(self.gain(blocks), edges_of(blocks, self.scale)) if blocks else []


def edges_of(blocks: list[Block], scale: float) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, scale * (SIBLINGS if blocks[k - 1].parent == b.parent else ADJACENT)))
        if b.parent in last and last[b.parent] != k - 1:
            edges.append((last[b.parent], k, scale * SAME_PARENT))
        last[b.parent] = k
    return edges


def labelled(pages: int, seed: int) -> list[tuple[list[Block], list[bool]]]:
    r = random.Random(seed)
    return [(blocks_of(text), labels) for text, labels in (made_page(r) for _ in range(pages))]


def accuracy(model: Model, pages: list[tuple[list[Block], list[bool]]]) -> float:
    right = [a == b for blocks, want in pages for a, b in zip(model.labels(blocks), want, strict=True)]
    return sum(right) / len(right)


@lru_cache(maxsize=1)
def fit(pages: int = FIT_PAGES, seed: int = 3) -> Model:
    """Logistic regression with a ridge, by Newton steps, on made pages; then the scale of the edges that labels others of them best."""
    made = labelled(pages, seed)
    learn, choose = made[: pages // 2], made[pages // 2 :]
    x = np.array([features(b) for blocks, _ in learn for b in blocks], np.float64)
    y = np.array([v for _, labels in learn for v in labels], np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (p - y) + RIDGE * w)
    return Model(w, max(SCALES, key=lambda s: (accuracy(Model(w, s), choose), -s)))


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side: gain > 0 is capacity from the source, gain < 0 capacity to the sink, edges go both ways."""
    n = len(gain)
    around = [0.0] * n
    beside: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a] += w
        around[b] += w
        beside[a].append((b, w))
        beside[b].append((a, w))
    # a node whose terminal outweighs all its edges is on that side in every minimum cut; its edges become its neighbours' terminals
    gain, label = list(gain), [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if label[v] is None and abs(gain[v]) > around[v]:
            label[v] = gain[v] > 0
            for u, w in beside[v]:
                if label[u] is None:
                    around[u] -= w
                    gain[u] += w if label[v] else -w
                    todo.append(u)
    rest = [v for v in range(n) if label[v] is None]
    if rest:
        number = {v: k + 2 for k, v in enumerate(rest)}
        graph: list[list[list]] = [[] for _ in range(len(rest) + 2)]

        def add(a: int, b: int, there: float, back: float) -> None:
            graph[a].append([b, there, len(graph[b])])
            graph[b].append([a, back, len(graph[a]) - 1])

        for v in rest:
            if gain[v] > 0:
                add(0, number[v], gain[v], 0.0)
            elif gain[v] < 0:
                add(number[v], 1, -gain[v], 0.0)
        for a, b, w in edges:
            if a in number and b in number:
                add(number[a], number[b], w, w)
        level = max_flow(graph)
        for v in rest:
            label[v] = level[number[v]] >= 0
    return label


def max_flow(graph: list[list[list]]) -> list[int]:
    """Dinic's algorithm from node 0 to node 1; the last levels tell what the source still reaches."""
    while True:
        level = [-1] * len(graph)
        level[0], todo = 0, deque([0])
        while todo:
            v = todo.popleft()
            for u, c, _ in graph[v]:
                if c > 1e-12 and level[u] < 0:
                    level[u] = level[v] + 1
                    todo.append(u)
        if level[1] < 0:
            return level
        turn = [0] * len(graph)
        while True:
            path, v = [], 0
            while v != 1:
                while turn[v] < len(graph[v]):
                    e = graph[v][turn[v]]
                    if e[1] > 1e-12 and level[e[0]] == level[v] + 1:
                        break
                    turn[v] += 1
                else:
                    if not path:
                        break
                    v, _ = path.pop()
                    turn[v] += 1
                    continue
                path.append((v, e))
                v = e[0]
            if v != 1:
                break
            least = min(e[1] for _, e in path)
            for _, e in path:
                e[1] -= least
                graph[e[0]][e[2]][1] += least


def main_text(page: str, model: Model | None = None) -> str:
    """Content blocks in page order, one line each; empty if there are none."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, content in zip(blocks, (model or fit()).labels(blocks), strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null or empty html, and pages without content, give an empty text with 0
    characters; pages of any length are read whole, in time proportional to
    their length; repeated rows each give a row, a null page_id or url stays
    null; an empty table gives none; other columns are ignored.
    """
    model = fit()

    def run(batches):
        for b in slabs(batches, 512):
            found = [main_text(t, model) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
