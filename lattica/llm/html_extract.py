"""Main text of web pages by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html as charrefs
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import give_back, slices, small_batches

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "head", "body"}
#: A new element of the key ends an open one of these, up to the nearest of the barriers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS |= {k: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for k in ("thead", "tbody", "tfoot")}

TAG_FEATURES = ("article", "main", "section", "div", "p", "heading", "list", "li", "table", "cell", "pre", "blockquote", "figure", "nav", "header", "footer", "aside", "form", "body", "html", "head", "raw", "dialog", "other")
TAG_OF = {"article": "article", "main": "main", "section": "section", "div": "div", "center": "div", "p": "p", **{f"h{i}": "heading" for i in range(1, 7)}, "hgroup": "section"}
TAG_OF |= {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "li", "dd": "li", "dt": "li", "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell"}
TAG_OF |= {k: k for k in ("pre", "blockquote", "nav", "header", "footer", "aside", "form", "body", "html", "head", "dialog")} | {k: "figure" for k in ("figure", "figcaption")} | {"fieldset": "form", "details": "section", "summary": "heading", "address": "footer"}
TAG_OF |= {k: "raw" for k in RAW}
#: Word stems in class, id and role that speak of what a block is.
NAMES = {
    "content": ("content", "article", "story", "post", "entry", "text", "main", "body", "prose", "copy"),
    "menu": ("nav", "menu", "breadcrumb", "crumb", "tabs", "toolbar", "pagination", "pager", "skip", "toc"),
    "advert": ("ad", "ads", "advert", "advertisement", "adsense", "adbox", "banner", "promo", "promoted", "sponsor", "sponsored", "dfp"),
    "comment": ("comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "reader", "readers", "guestbook"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "subscribe", "newsletter", "signup", "warning", "message", "privacy"),
    "edge": ("header", "masthead", "topbar", "footer", "foot", "copyright", "legal", "colophon", "imprint", "logo"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "recommend", "trending", "popular", "more", "rail", "share", "social", "tags", "meta", "byline", "author", "bio"),
    "form": ("form", "search", "login", "signin", "register", "contact"),
}
NAME_WORDS = {w: k for k, ws in NAMES.items() for w in ws}
SHAPES = ("bias", "no text", "short", "long", "many links", "some links", "no links", "sentence", "copyright", "hidden", "own text", "own long")
FEATURES = (*(f"tag {t}" for t in TAG_FEATURES), *(f"name {n}" for n in NAMES), *SHAPES)
AT = {f: i for i, f in enumerate(FEATURES)}

#: Attributes of a tag; a quote opens a value only after a sign of equality, and an unclosed one runs to the page's end.
INSIDE = r"""((?:[^>=]|=(?!\s*["'])|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z))*+)(?:>|\Z)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*){INSIDE}", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
LETTERS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """A page's block elements: parents (-1: none) before children, tags, attributes; text runs by block."""

    parent: list[int]
    tag: list[str]
    names: list[str]
    mark: list[str | None]
    runs: list[tuple[int, str, bool]]  # block, text as in the page, inside a link
    breaks: set[int]  # indexes of runs before which a block or line ends


class Open:
    """The open elements: a stack that knows where each tag and the last block stand, so that no step searches it."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.at: dict[str, list[int]] = {}  # places of each tag above the root
        self.blocks: list[int] = []  # places of blocks above the root

    def push(self, tag: str, block: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, block))

    def last(self, tags) -> int:
        """The highest place of any of the tags; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_above(self, tags, place: int) -> int:
        """The lowest place above `place` of any of the tags; 0 if there is none."""
        found = (own[k] for t in tags if (own := self.at.get(t)) and (k := bisect_right(own, place)) < len(own))
        return min(found, default=0)

    def block_above(self, place: int) -> bool:
        return bool(self.blocks) and self.blocks[-1] > place

    def pop_to(self, place: int) -> bool:
        """Close everything from `place` up; whether a block was among it."""
        blocks = self.block_above(place - 1)
        for tag, _ in reversed(self.stack[place:]):
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
        del self.stack[place:]
        return blocks


def attributes(inside: str) -> dict[str, str]:
    """Names in lower case with their values; of repeated names the first."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(inside):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def parse(source: str) -> Page:
    """A lenient parser: any input gives a tree, in time that grows with its length only; character references are left for later."""
    page = Page([-1], ["html"], [""], [None], [], set())
    opened = Open()
    at, size = 0, len(source)
    unended: set[str] = set()  # raw tags that nothing more ends

    def pop_to(place: int) -> None:
        if opened.pop_to(place):
            page.breaks.add(len(page.runs))

    def text(s: str) -> None:
        if s:
            page.runs.append((opened.stack[-1][1], s, bool(opened.at.get("a"))))

    while at < size:
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, closed = m[2].lower(), m[3].endswith("/")
        if m[1]:
            place = opened.last((tag,))
            if place and (tag in BLOCK or not opened.block_above(place)):
                pop_to(place)
            elif tag in ("p", "br"):
                page.breaks.add(len(page.runs))
            continue
        if tag in CLOSES_P and opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
            pop_to(opened.blocks[-1])
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            if place := opened.first_above(ended, opened.last(barrier)):
                pop_to(place)
        if tag == "a" and (place := opened.last(("a",))) and not opened.block_above(place):
            pop_to(place)
        if tag in RAW:
            if not closed:
                end = None if tag in unended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if not end:
                    unended.add(tag)
                at = end.end() if end else size
            if tag in ("textarea", "iframe", "select", "object"):
                page.breaks.add(len(page.runs))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                page.breaks.add(len(page.runs))
            continue
        block = opened.stack[-1][1]
        if tag in BLOCK:
            page.breaks.add(len(page.runs))
            found = attributes(m[3]) if m[3] else {}
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
            page.parent.append(block)
            page.tag.append(tag)
            page.names.append(" ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label")) + (" \0" if hidden else ""))
            page.mark.append(found.get("data-mark"))
            block = len(page.tag) - 1
        if not closed or tag in BLOCK:
            opened.push(tag, block)
    return page


def features(page: Page) -> np.ndarray:
    """A row of FEATURES, 0 or 1, for every block."""
    n = len(page.tag)
    x = np.zeros((n, len(FEATURES)), np.uint8)
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    rights = np.zeros(n, bool)
    for block, s, link in page.runs:
        k = len(s.strip())
        own[block] += k
        linked[block] += k * link
        stops[block] += 0 if link else s.count(". ") + s.rstrip().endswith((".", "!", "?"))
        rights[block] |= "&copy" in s or "©" in s
    whole, whole_link = own.copy(), linked.copy()
    for i in range(n - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
        whole_link[page.parent[i]] += whole_link[i]
    density = whole_link / np.maximum(whole, 1)
    for i, (tag, names) in enumerate(zip(page.tag, page.names)):
        x[i, AT[f"tag {TAG_OF.get(tag, 'other')}"]] = 1
        if names.strip():
            x[i, AT["hidden"]] = "\0" in names
            for w in LETTERS.findall(CAMEL.sub(" ", names).lower()):
                if w in NAME_WORDS:
                    x[i, AT[f"name {NAME_WORDS[w]}"]] = 1
    x[:, AT["bias"]] = 1
    x[:, AT["no text"]] = whole == 0
    x[:, AT["short"]] = (whole > 0) & (whole < 40)
    x[:, AT["long"]] = whole >= 200
    x[:, AT["many links"]] = density > 0.5
    x[:, AT["some links"]] = (density > 0.15) & (density <= 0.5)
    x[:, AT["no links"]] = (whole > 0) & (density <= 0.15)
    x[:, AT["sentence"]] = stops > 0
    x[:, AT["copyright"]] = rights
    x[:, AT["own text"]] = own > 0
    x[:, AT["own long"]] = own >= 80
    return x


@dataclass
class TreeModel:
    """Node potentials linear in the features, and a 2 x 2 parent-child table for each kind of child tag."""

    node: np.ndarray  # features
    edge: np.ndarray  # (tag features, 2, 2): by the parent's and the child's label

    def marginals(self, x: np.ndarray, parent: list[int], pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """Sum-product, up then down: P(content) of each node, P(parent's, own label) of each edge, log Z."""
        n = len(parent)
        kinds = x[:, : len(TAG_FEATURES)].argmax(1)
        score = np.zeros((n, 2))
        for lo in range(0, n, 4096):
            score[lo : lo + 4096, 1] = x[lo : lo + 4096] @ self.node
        table = self.edge[kinds]
        logs, child_msg = score.tolist(), [(0.0, 0.0)] * n
        tables = table.tolist()

        def add(a: float, b: float) -> float:
            hi, lo = (a, b) if a > b else (b, a)
            return hi if lo < hi - 40 else hi + math.log1p(math.exp(lo - hi))

        for i in range(n - 1, 0, -1):
            (t00, t01), (t10, t11) = tables[i]
            s0, s1 = logs[i]
            m0, m1 = add(t00 + s0, t01 + s1), add(t10 + s0, t11 + s1)
            child_msg[i] = (m0, m1)
            up = logs[parent[i]]
            up[0] += m0
            up[1] += m1
        log_z = add(*logs[0])
        p1 = [math.exp(logs[0][1] - log_z)] * n
        pair = np.zeros((n, 2, 2)) if pairs else None
        for i in range(1, n):
            q, (m0, m1), s1, ((_, t01), (_, t11)) = p1[parent[i]], child_msg[i], logs[i][1], tables[i]
            a, b = math.exp(min(0.0, t01 + s1 - m0)), math.exp(min(0.0, t11 + s1 - m1))
            p1[i] = (1 - q) * a + q * b
            if pairs:
                pair[i] = (((1 - q) * (1 - a), (1 - q) * a), (q * (1 - b), q * b))
        return np.array(p1), pair, log_z

    def gradient(self, x: np.ndarray, parent: list[int], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of one labelled page: observed less expected counts."""
        p, pair, _ = self.marginals(x, parent, True)
        g_edge = np.zeros_like(self.edge)
        kinds = x[:, : len(TAG_FEATURES)].argmax(1)
        up = y[np.array(parent[1:], int)]
        np.add.at(g_edge, (kinds[1:], up, y[1:]), 1)
        np.add.at(g_edge, kinds[1:], -pair[1:])
        return x.T @ (y - p), g_edge


def train_tree(pages: list[tuple[Page, np.ndarray]], steps: int = 60, rate: float = 0.5, ridge: float = 0.02) -> TreeModel:
    """Maximum likelihood with a ridge, by Adagrad over whole passes."""
    model = TreeModel(np.zeros(len(FEATURES)), np.zeros((len(TAG_FEATURES), 2, 2)))
    rows = [(features(p), p.parent, y) for p, y in pages]
    s_node, s_edge = np.full_like(model.node, 1e-6), np.full_like(model.edge, 1e-6)
    for _ in range(steps):
        g_node, g_edge = -ridge * model.node * len(rows) / 10, -ridge * model.edge * len(rows) / 10
        for x, parent, y in rows:
            a, b = model.gradient(x, parent, y)
            g_node, g_edge = g_node + a, g_edge + b
        s_node, s_edge = s_node + g_node**2, s_edge + g_edge**2
        model.node = model.node + rate * g_node / np.sqrt(s_node)
        model.edge = model.edge + rate * g_edge / np.sqrt(s_edge)
    return model


def main_text(source: str | None, model: TreeModel, least: float = 0.5) -> str:
    """Text of the blocks whose content marginal is `least` or more, in page order."""
    if not source:
        return ""
    page = parse(source)
    if not page.runs:
        return ""
    p, _, _ = model.marginals(features(page), page.parent)
    out: list[str] = []
    for i, (block, s, _) in enumerate(page.runs):
        if i in page.breaks:
            out.append(" ")
        if p[block] >= least:
            out.append(charrefs.unescape(s))
        elif out and out[-1] != " ":
            out.append(" ")
    return " ".join("".join(out).split())


def extract(df: DataFrame, model: TreeModel, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, `keep`, text, n_chars) for every row: one narrow pass over whole pages.

    Null, empty and text-less pages give an empty text; null ids stay null. Repeated rows give repeated
    results, an empty table none. Columns other than those named are not read, so names cannot clash.
    Very long, deeply nested and malformed pages are read whole, in time and memory that grow with
    their length. White space is what `str.split` parts at, no-break spaces among it.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, len(names))):
            texts = [main_text(h, model) for h in b.column(len(names)).to_pylist()]
            cols = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f"c{i}" for i in range(len(names))), "text", "n_chars"])
        give_back()

    small_batches(df.sparkSession)
    rows = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(html_col).cast("string").alias("html"))
    schema = ", ".join(f"c{i} {types[c]}" for i, c in enumerate(names))
    done = rows.mapInArrow(run, f"{schema}, text string, n_chars long")
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "text", "n_chars")
