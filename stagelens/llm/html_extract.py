"""Main text of pages by a tree-structured graphical model.

Each block element and each block of text of a page's DOM is a binary variable: does it hold content? Potentials of
a node come from its element, its class names and its text; potentials of an edge from what kind of child it is and
whether parent and child hold content. Sum-product messages go up and down the tree and give each variable's exact
marginal; the weights maximise the likelihood of labelled pages, whose gradient needs the same marginals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Node, parse
from .labelled_pages import MARK, labelled_pages

# Words in class names, ids and roles that tell what an element is for.
HINTS = {
    "content": "article articlebody content post entry story main body text page prose markdown hentry".split(),
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc sitemap skip".split(),
    "edge": "header head masthead top topbar footer foot bottom colophon copyright legal site contentinfo".split(),
    "side": "sidebar side aside rail related recommend recommended recommendations more popular trending widget widgets tags tagcloud archive archives complementary".split(),
    "advert": "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted banner teaser dfp".split(),
    "notice": "cookie cookies consent gdpr notice notification alert banner popup modal overlay dialog paywall disclaimer message warning".split(),
    "comment": "comment comments commentlist commentary disqus reply replies respond discussion feedback thread".split(),
    "social": "share sharing social follow like tweet facebook twitter".split(),
    "form": "form login signin signup register subscribe subscription newsletter search searchform contact input".split(),
}
_WORDS = {w: i for i, words in enumerate(HINTS.values()) for w in words}
_TAGS = ["html", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "cell", "p", "heading", "quote", "pre", "figure", "dl", "details", "headline", "other"]
_KIND = {"ol": "ul", "menu": "ul", "td": "cell", "th": "cell", "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "cell", "blockquote": "quote", "figcaption": "figure", "dt": "dl", "dd": "dl", "summary": "details", "fieldset": "form", "legend": "form", "center": "div", "address": "footer"}
_NOTICE = re.compile(r"(?i)©|\(c\) ?\d|copyright|all rights reserved|cookie|privacy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in|advert|sponsored|share this|leave a (?:reply|comment)")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

@lru_cache(50_000)
def _hinted(hints: str) -> tuple[int, ...]:
    return tuple(sorted({_WORDS[w] for w in (x.lower() for x in _SPLIT.split(hints)) if w in _WORDS}))


def _tag(tag: str) -> int:
    kind = "heading" if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else _KIND.get(tag, tag)
    return _TAGS.index(kind) if kind in _TAGS else len(_TAGS) - 1


_TAG_OF: dict[str, int] = {}
_HEADLINE = _TAGS.index("headline")
_MAIN = (_TAGS.index("article"), _TAGS.index("main"))
#: Elements of a single block say nothing by kind or size; those of a long article would outvote its own element.
_SMALL = frozenset(_TAGS.index(t) for t in ("p", "heading", "li", "cell", "pre", "figure", "dl", "quote"))


N_TAGS, N_HINTS, N_TEXT, N_TREE = len(_TAGS), len(HINTS), 4, 5
WIDTH = 1 + N_TAGS + N_HINTS + N_TEXT + N_TREE
#: Kinds of edges: by the child's element, the leaf last; children with a hint other than content have kinds of
#: their own.
EDGES = 2 * (N_TAGS + 1)
#: Plain blocks agree with their parents or not, but are no evidence by themselves, however many there are.
_PLAIN = np.array([*(2 * t for t in sorted(_SMALL)), 2 * N_TAGS])
PAGES, STEPS, RATE, PENALTY = 420, 240, 0.1, 2e-4


@dataclass
class Forest:
    """Pages' trees one after the other: parents, depths, node features and kinds of edges to the parents."""

    parent: np.ndarray
    depth: np.ndarray
    features: np.ndarray
    kind: np.ndarray

    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)


def forest(pages: list[list[Node]]) -> Forest:
    many = sum(map(len, pages))
    parent, depth, kind = np.full(many, -1), np.zeros(many, np.int64), np.zeros(many, np.int64)
    x = np.zeros((many, WIDTH), np.float32)
    at = 0
    text0 = 1 + N_TAGS + N_HINTS
    for nodes in pages:
        base = at
        sizes, linked = [len(n.text) for n in nodes], [n.linked for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            sizes[nodes[k].parent] += sizes[k]
            linked[nodes[k].parent] += linked[k]
        for k, node in enumerate(nodes):
            row = x[at]
            parent[at] = node.parent + base if node.parent >= 0 else -1
            depth[at] = node.depth
            if node.tag == "#":
                t = node.text
                size = len(t)
                dense = node.linked / size
                notice = _NOTICE.search(t) is not None
                row[text0 : text0 + N_TEXT] = dense, dense > 0.6, notice, notice and size < 200
                kind[at] = 2 * N_TAGS
            else:
                tag = _TAG_OF.get(node.tag)
                if tag is None:
                    tag = _TAG_OF[node.tag] = _tag(node.tag)
                hints = _hinted(node.hints) if node.hints else ()
                if node.tag == "header" and nodes[node.parent].tag == "article":  # an article's own heading
                    tag, hints = _HEADLINE, ()
                other = any(h > 0 for h in hints)
                row[0] = tag not in _SMALL
                row[1 + (len(_TAGS) - 1 if other and tag in _MAIN else tag)] = tag not in _SMALL  # an article named comment is no article
                for h in hints:
                    row[1 + N_TAGS + h] = 1
                kind[at] = 2 * tag + other
                if (size := sizes[k]) and tag not in _SMALL:
                    share, dense = size / sizes[0], linked[k] / size
                    row[text0 + N_TEXT :] = log10(1 + size) / 3, dense, share, share > 0.5, size > 300 and dense < 0.3
            at += 1
    return Forest(parent, depth, x, kind)


def _both(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the last axis, of two."""
    return np.logaddexp(x[..., 0], x[..., 1])


def marginals(f: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(content) of each node, P(parent, node) of each edge (zero at roots), and the sum of log partition
    functions. edges: [kind, parent's value, node's value]."""
    levels = f.levels()
    belief = np.zeros((len(f.parent), 2))
    belief[:, 1] = f.features @ weights
    message = np.zeros_like(belief)
    for level in levels[:0:-1]:  # up: what a subtree says about its parent
        message[level] = _both(belief[level][:, None, :] + edges[f.kind[level]])
        np.add.at(belief, f.parent[level], message[level])
    roots = levels[0]
    total = belief.copy()
    for level in levels[1:]:  # down: what the rest of the page says about a node
        rest = total[f.parent[level]] - message[level]
        total[level] = belief[level] + _both(np.swapaxes(rest[:, :, None] + edges[f.kind[level]], 1, 2))
    p = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60)))
    pair = np.zeros((len(f.parent), 2, 2))
    low = np.flatnonzero(f.parent >= 0)
    joint = (total[f.parent[low]] - message[low])[:, :, None] + edges[f.kind[low]] + belief[low][:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    pair[low] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return p, pair, float(_both(total[roots]).sum())


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """Weights of nodes and of edges, fitted on PAGES labelled pages by Adam."""
    return fit(labelled_pages(PAGES))


def labels(nodes: list[Node]) -> np.ndarray:
    """Truth of a labelled page: a leaf with the mark is content, an element is if it holds any. Takes marks off."""
    y = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].tag == "#" and MARK in nodes[i].text:
            y[i] = 1
            nodes[i].text = nodes[i].text.replace(MARK, "")
        if y[i] and nodes[i].parent >= 0:
            y[nodes[i].parent] = 1
    return y


def fit(sources: list[str], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    pages = [parse(s) for s in sources]
    y = np.concatenate([labels(p) for p in pages])
    f = forest(pages)
    low = np.flatnonzero(f.parent >= 0)
    true = np.zeros((EDGES, 2, 2))
    np.add.at(true, (f.kind[low], y[f.parent[low]].astype(int), y[low].astype(int)), 1)
    state = [np.zeros(WIDTH), np.zeros((EDGES, 2, 2))]
    m, v = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for k in range(1, steps + 1):
        p, pair, _ = marginals(f, *state)
        expected = np.zeros_like(true)
        np.add.at(expected, f.kind[low], pair[low])
        slopes = [f.features.T @ (p - y) / len(sources), (expected - true) / len(sources)]
        for i in range(2):
            g = slopes[i] + PENALTY * state[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            state[i] = state[i] - RATE * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
        plain = state[1][_PLAIN]
        plain[:, 0, 0] = plain[:, 1, 1] = (plain[:, 0, 0] + plain[:, 1, 1]) / 2
        state[1][_PLAIN] = plain
    return state[0], state[1]


def texts(sources: list[str], fitted: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Main text of each page: its content blocks in page order, joined by line ends."""
    pages = [parse(s) for s in sources]
    p, _, _ = marginals(forest(pages), *fitted)
    out, at = [], 0
    for nodes in pages:
        out.append("\n".join(n.text for n, q in zip(nodes, p[at : at + len(nodes)], strict=True) if n.tag == "#" and q >= 0.5))
        at += len(nodes)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row: main text of the whole html, in blocks joined by line ends.

    Null and empty html, and pages without content, give the empty string. Rows aren't joined or grouped, so
    repeated and null page_ids pass through; other columns aren't read.
    """
    fitted = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                found = texts([x or "" for x in part["html"].to_pylist()], fitted.value)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
