"""Main-content extraction by a tree-structured graphical model over the DOM.

Every element that holds text, itself or below, is a binary variable (content or not). Unary potentials are log-linear
in features of the element; each parent-child edge has a 2 x 2 table by kind of edge. Sum-product messages go from the
leaves up and from the root down, level by level for all pages of a batch at once, and give exact marginals. Weights are
trained by gradient ascent on the likelihood of labelled pages, whose gradient is observed minus expected features.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[\"'>]")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}}
_SCOPE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "tbody": {"table"}, "option": {"select"}}
#: Landmarks say what is content on labelled pages, and are hidden from the features.
LANDMARKS = frozenset({"article", "main"})
NOT_CONTENT = frozenset({"nav", "footer", "aside", "header", "form", "script", "style", "head"})
TAGS = ["p", "div", "li", "ul", "ol", "a", "h1", "h2", "h3", "h4", "span", "b", "i", "em", "strong", "td", "tr", "table", "nav", "footer", "header", "aside", "section", "pre", "code", "blockquote", "title", "head", "body", "html", "form", "button", "label", "dl", "figure", "?"]
_TAG_NO = {t: i for i, t in enumerate(TAGS)}
_HINT_BAD = re.compile(r"\b(?:ad|ads|advert\w*|banner|nav\w*|menu|footer|foot|sidebar|share|social|comment\w*|cookie\w*|promo\w*|related|breadcrumb\w*|widget)\b", re.I)
_HINT_GOOD = re.compile(r"\b(?:content|article|post|entry|story|body|main|text)\b", re.I)
N_BINS = 6
N_FEATURES = len(TAGS) + 3 * N_BINS + 8
TRAIN_PAGES = 400
THRESHOLD = 0.5


class Page:
    """Elements in document order: tag, parent (-1 for the root), attributes; and text segments (element, text)."""

    __slots__ = ("tag", "parent", "attr", "seg")

    def __init__(self):
        self.tag, self.parent, self.attr, self.seg = ["#root"], [-1], [""], []


def _tag_end(text: str, at: int, heed: bool) -> tuple[int, bool]:
    """Where the tag that is open at ``at`` has its ">" (-1 if nowhere), quotes heeded; and whether quotes still are.

    If the quotes of a tag leave it open to the end of the page, they are stray: the tag ends with the first ">", and
    quotes aren't heeded any more, so that no second tag is followed to the end.
    """
    i = at
    while heed:
        m = _STOP.search(text, i)
        if not m:
            heed = False
        elif m[0] == ">":
            return m.start(), True
        else:
            i = text.find(m[0], m.end()) + 1
            heed = i > 0
    return text.find(">", at), False


class _Open:
    """Open elements from the root down, with the places of each tag and of the blocks among them."""

    def __init__(self, tags: list[str]):
        self.tags, self.stack, self.blocks = tags, [0], []
        self.at: dict[str, list[int]] = {}

    def push(self, e: int) -> None:
        t = self.tags[e]
        self.at.setdefault(t, []).append(len(self.stack))
        if t in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, k: int) -> None:
        """Close the element at place k and all within it."""
        while len(self.stack) > k:
            t = self.tags[self.stack.pop()]
            self.at[t].pop()
            if t in _BLOCK:
                self.blocks.pop()


def parse(text: str | None) -> Page:
    """A tolerant parse: unclosed and stray tags are mended, comments and scripts skipped; never fails.

    One pass over the page, whose time is linear in its length however broken it is.
    """
    p = Page()
    if not text:
        return p
    at, n, heed, tags = 0, len(text), True, p.tag
    open_ = _Open(tags)
    no_end = False  # whether there is no ">" ahead

    def put(s: str) -> None:
        if s and not s.isspace():
            p.seg.append((open_.stack[-1], html.unescape(s)))

    start = 0  # of the text not yet put
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            break
        if text.startswith("<!--", lt) or text.startswith("<![CDATA[", lt):
            mark, inner = ("-->", lt + 4) if text[lt + 2] == "-" else ("]]>", lt + 9)
            put(text[start:lt])
            end = text.find(mark, inner)
            if mark == "]]>":
                put(text[inner : end if end >= 0 else n])
            start = at = end + 3 if end >= 0 else n
            continue
        m = _NAME.match(text, lt + 1)
        if no_end or not m and text[lt + 1 : lt + 2] not in ("!", "?"):
            at = lt + 1
            continue
        if m:
            end, heed = _tag_end(text, m.end(), heed)
        else:
            end = text.find(">", lt)
        if end < 0:
            no_end, at = True, lt + 1
            continue
        put(text[start:lt])
        start = at = end + 1
        if not m:
            continue
        name = m[2].lower()
        if m[1]:
            if open_.at.get(name):
                open_.close(open_.at[name][-1])
            continue
        if name in _CLOSES:
            k = open_.last(_CLOSES[name])
            if k > open_.last(_SCOPE[name]):
                open_.close(k)
        elif name in _BLOCK and open_.blocks and tags[open_.stack[open_.blocks[-1]]] == "p":
            open_.close(open_.blocks[-1])  # a block ends an open paragraph
        attr = text[m.end() : end]
        tags.append(name)
        p.parent.append(open_.stack[-1])
        p.attr.append(attr if "=" in attr else "")
        if name in _RAW_END:
            raw = _RAW_END[name].search(text, at)
            start = at = raw.end() if raw else n
        elif name not in _VOID and not attr.rstrip().endswith("/"):
            open_.push(len(tags) - 1)
    put(text[start:])
    return p


class Forest:
    """The elements of many pages: page, parent and depth of each, features, kind of the edge to the parent."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        n = int(base[-1])
        self.pages, self.base = pages, base
        self.page = np.repeat(np.arange(len(pages)), sizes)
        local = np.fromiter((x for p in pages for x in p.parent), np.int64, n)
        self.parent = np.where(local >= 0, local + base[self.page], -1)
        self.tags = [t for p in pages for t in p.tag]
        self.depth = np.zeros(n, np.int32)
        # parents come before children
        depth, parent = self.depth.tolist(), self.parent.tolist()
        for i in range(n):
            if parent[i] >= 0:
                depth[i] = depth[parent[i]] + 1
        self.depth = np.array(depth, np.int32)
        self.seg = np.fromiter((base[k] + e for k, p in enumerate(pages) for e, _ in p.seg), np.int64)
        own = np.zeros(n)
        stops = np.zeros(n)
        if len(self.seg):
            texts = [t for p in pages for _, t in p.seg]
            np.add.at(own, self.seg, np.fromiter((len(t) for t in texts), np.float64, len(texts)))
            np.add.at(stops, self.seg, np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts), np.float64, len(texts)))
        link = np.where(np.fromiter((t == "a" for t in self.tags), bool, n), own, 0.0)
        under, linked, punct = own.copy(), link.copy(), stops.copy()
        self.levels = np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1]) if n else []
        for lv in self.levels[:0:-1]:
            par = self.parent[lv]
            np.add.at(under, par, under[lv])
            np.add.at(punct, par, punct[lv])
            a = np.fromiter((self.tags[i] == "a" for i in lv), bool, len(lv))
            np.add.at(linked, par, np.where(a, under[lv], linked[lv]))
        self.own, self.under = own, under
        self.edge = np.fromiter((0 if t in _BLOCK else 1 for t in self.tags), np.int64, n)
        self.x = self._features(own, under, linked, punct)

    def _features(self, own, under, linked, punct) -> np.ndarray:
        n = len(own)
        x = np.zeros((n, N_FEATURES), np.float32)
        r = np.arange(n)
        x[r, np.fromiter((_TAG_NO.get("?" if t in LANDMARKS else t, len(TAGS) - 1) for t in self.tags), np.int64, n)] = 1
        at = len(TAGS)
        for v in (own, under):
            x[r, at + np.minimum(np.log2(1 + v) / 2, N_BINS - 1).astype(np.int64)] = 1
            at += N_BINS
        share = np.where(under > 0, linked / np.maximum(under, 1), 0.0)
        x[r, at + np.minimum(share * N_BINS, N_BINS - 1).astype(np.int64)] = 1
        at += N_BINS
        attrs = [a for p in self.pages for a in p.attr]
        x[:, at] = [1.0 if a and _HINT_BAD.search(a) else 0.0 for a in attrs]
        x[:, at + 1] = [1.0 if a and _HINT_GOOD.search(a) else 0.0 for a in attrs]
        x[:, at + 2] = np.minimum(self.depth / 8, 2)
        x[:, at + 3] = np.minimum(40 * punct / np.maximum(under, 20), 2)
        x[:, at + 4] = under == 0
        root = under[self.base[self.page]]
        x[:, at + 5] = under / np.maximum(root, 1)
        place = (r - self.base[self.page]) / np.maximum(np.diff(self.base)[self.page], 1)
        x[:, at + 6] = place
        x[:, at + 7] = 1
        return x


def sum_product(f: Forest, score: np.ndarray, pair: np.ndarray, edges: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of content, and edge marginals (edge, parent's label, child's label) of the non-root elements.

    ``score`` is each element's log potential of content against none; ``pair`` is (kind, parent, child). Without
    ``edges`` their marginals, which training needs, are left at 0.
    """
    n = len(score)
    up = np.zeros((n, 2))
    up[:, 1] = score
    msg = np.zeros((n, 2))
    for lv in f.levels[:0:-1]:
        t = pair[f.edge[lv]] + up[lv][:, None, :]
        m = np.logaddexp(t[:, :, 0], t[:, :, 1])
        m -= m.max(1, keepdims=True)
        msg[lv] = m
        np.add.at(up, f.parent[lv], m)
    down = np.zeros((n, 2))
    joint = np.zeros((n if edges else 0, 2, 2))
    for lv in f.levels[1:]:
        par = f.parent[lv]
        above = up[par] + down[par] - msg[lv]
        t = above[:, :, None] + pair[f.edge[lv]]
        d = np.logaddexp(t[:, 0], t[:, 1])
        d -= d.max(1, keepdims=True)
        down[lv] = d
        if not edges:
            continue
        j = t + up[lv][:, None, :]
        j = np.exp(j - j.max((1, 2), keepdims=True))
        joint[lv] = j / j.sum((1, 2), keepdims=True)
    b = up + down
    return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -500, 500))), joint


def landmark_labels(f: Forest) -> np.ndarray:
    """1 for elements at or below a landmark, and not below navigation and the like inside it."""
    y = np.zeros(len(f.tags), np.int64)
    for i, t in enumerate(f.tags):
        p = f.parent[i]
        y[i] = 0 if t in NOT_CONTENT else 1 if t in LANDMARKS else y[p] if p >= 0 else 0
    return y


class Model:
    def __init__(self, w: np.ndarray, pair: np.ndarray):
        self.w, self.pair = w, pair

    def marginals(self, f: Forest) -> np.ndarray:
        return sum_product(f, f.x @ self.w, self.pair, False)[0]


def train(pages: list[Page], labels: list[np.ndarray] | None = None, steps: int = 150, rate: float = 0.3, l2: float = 1e-3) -> Model:
    """Maximum likelihood with L2, by Adam; labels are those of the landmarks unless given."""
    f = Forest(pages)
    n = len(f.tags)
    y = landmark_labels(f) if labels is None else np.concatenate(labels)
    w, pair = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    if not n:
        return Model(w, pair)
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (f.edge[child], y[f.parent[child]], y[child]), 1)
    theta, m, v = np.zeros(N_FEATURES + 8), np.zeros(N_FEATURES + 8), np.zeros(N_FEATURES + 8)
    for step in range(1, steps + 1):
        w, pair = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)
        mu, joint = sum_product(f, f.x @ w, pair)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, f.edge[child], joint[child])
        g = np.concatenate((f.x.T @ (y - mu), (seen - expected).ravel())) / n - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))


def content(f: Forest, mu: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(text, elements, content elements with text, mean marginal of the text's characters) of each page."""
    out = []
    for k, p in enumerate(f.pages):
        base = f.base[k]
        parts, last, got, weight, total = [], None, set(), 0.0, 0
        block = []  # of each element the innermost block around it
        for e, t in enumerate(p.tag):
            block.append(e if not e or t in _BLOCK else block[p.parent[e]])
        for e, t in p.seg:
            q = mu[base + e]
            if q >= threshold:
                b = block[e]
                parts.append(("" if b == last or last is None else "\n") + (t if b == last else t.lstrip()))
                last = b
                got.add(e)
                weight += q * len(t)
                total += len(t)
        lines = (x.lstrip() for x in "".join(parts).split("\n"))
        text = "\n".join(x.rstrip(" \t\r\f\v") for x in lines if x).strip()
        out.append((text, len(p.tag) - 1, len(got), weight / total if total else 0.0))
    return out


def train_on(pages: DataFrame, *, train_pages: int = TRAIN_PAGES, seed: int = 7, id_col: str = "page_id", html_col: str = "html") -> Model:
    """A model of pages with landmarks: ``train_pages`` of them at most, those of the smallest seeded hash of the id.

    Landmark tags are hidden from the features, so the model carries over to pages without them. With no such page
    every element is content with probability one half.
    """
    d = pages.select(F.col(html_col).cast("string").alias("h"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("o")).where(F.col("h").rlike("(?i)<(?:article|main)[\\s>]"))
    # the smallest hashes first, so that no task sends more than hashes to the driver
    cut = d.select("o").orderBy("o").limit(train_pages).agg(F.max("o")).first()[0]
    rows = [] if cut is None else d.where(F.col("o") <= cut).limit(2 * train_pages).collect()
    rows = sorted(rows, key=lambda r: (r["o"], r["h"]))[:train_pages]
    return train([parse(r["h"]) for r in rows])


#: Pages whose elements are held at a time.
PAGES_AT_ONCE = 500


def extract_content(pages: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_elements, n_content, confidence) of every row.

    text joins, in document order, the text of elements whose marginal reaches the threshold, one line a block;
    n_content counts those elements and confidence is the mean marginal of the text's characters (6 places). A null or
    empty page has empty text, no elements and confidence 0. Pages are used whole, however long or broken, in time linear
    in their length: see ``parse``. Equal marginals need no order, as elements don't compete. Null ids and
    repeated rows are kept each. Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in (x.slice(i, PAGES_AT_ONCE) for x in batches for i in range(0, x.num_rows, PAGES_AT_ONCE)):
            f = Forest([parse(h) for h in b.column(1).to_pylist()])
            text, n, got, conf = zip(*content(f, model.marginals(f), threshold))
            yield pa.record_batch([b.column(0), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(got, pa.int32()), pa.array(np.round(conf, 6))], names=["page_id", "text", "n_elements", "n_content", "confidence"])

    d = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return d.mapInArrow(run, f"page_id {kind}, text string, n_elements int, n_content int, confidence double")
