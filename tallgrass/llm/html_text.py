"""Operator 9: main text of web pages by minimum cut.

A page is cut into blocks at block-level tags.  Each block gets two costs, of calling it
boilerplate and of calling it content: from the log-odds of a logistic classifier over the
block's own text (words, link share, sentence ends, heading) plus those of a hint, which sums
up what enclosing elements say (`article`, `nav`, class="sidebar" and the like).  The nearest
one that says something counts whole, those around it half; a name that is a class of its own
counts double, one within a longer class once, and modifiers ("has-sidebar") and the classes
of body, html and main not at all, of an article only the first.  So neither hints nor text
alone decide, and the cut weighs both with what stands beside a block.  The costs become the
capacities to the two terminals.  Smoothness edges join each block with the next one and
with the next one of the same parent element, the weaker the further apart they are in the
DOM.  A maximum flow separates content from boilerplate at least cost.

The classifier is trained here, on the blocks of at most about TRAIN_PAGES pages whose
elements say what they are; with fewer than LEAST_SEEDS blocks of a kind the PRIOR weights
are used as they are.

Text: character references are decoded, runs of white space in a block become one blank,
empty blocks vanish, and blocks are joined in page order by two line feeds.

Cases: null or empty html, and pages without content, give an empty text; unclosed or stray
tags, comments and quotes are read as browsers do in the main; very long pages are read
whole; repeated rows each get a text; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400
LEAST_SEEDS = 200
#: Log-odds of content for a hint of 1, and the largest hint.
HINT = 4.0
MOST_HINT = 2.0
SMOOTH = 1.0
#: Capacities are whole numbers, so that the flow is exact.
UNITS = 1_000
#: Weights of 1, log words, link share, sentence ends a word, heading: log-odds of content.
PRIOR = np.array([-1.2, 0.9, -4.0, 2.0, 0.3])

#: Element names, and words in class, id and role, by what they say.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr pre dt caption legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset(
    "script style noscript template title textarea iframe svg select button option object canvas audio video math datalist head form".split()
)
RAW = frozenset("script style title textarea iframe".split())
SAYS_BOILERPLATE = frozenset("nav footer aside menu dialog".split())
SAYS_CONTENT = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo"
    " cookie cookies consent disqus disclaimer footer gdpr header login masthead menu menubar meta modal nav navbar navigation newsletter"
    " notice notices pager pagination popup promo promoted promotion related replies reply respond rss search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody content entry main post story text".split())
MODIFIERS = frozenset("category format has hide is no show status tag type with without".split())
UNSAYING = frozenset("body html main".split())

_NAME, _QUIET = r"[a-zA-Z][^\s/>]*", r"""(?:[^<>"']++|"[^"<]*"|'[^'<]*')*+"""
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(?P<end>/?)(?P<name>{_NAME})(?P<rest>{_QUIET})>|<(?P<end2>/?)(?P<name2>{_NAME})(?P<rest2>[^<>]*)>",
    re.S,
)
_SAYING = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CLASSES = re.compile(r"[^\s\"']+").findall
_WORDS = re.compile(r"[a-z0-9]+").findall
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSERS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in UNSEEN}
_BODY = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters of it within links
    heading: bool
    parent: int  # number of the innermost container
    depth: int
    says: float  # hint: above 0 content, below boilerplate

    def features(self) -> list[float]:
        words = self.text.count(" ") + 1
        ends = sum(map(self.text.count, ".!?"))
        return [1.0, float(np.log1p(words)), self.linked / max(1, len(self.text)), min(1.0, ends / words), float(self.heading)]


def _vote(name: str) -> float:
    """What one class, id or role says."""
    words = _WORDS(_CAMEL.sub(" ", name).lower())
    if not words or words[0] in MODIFIERS:
        return 0.0
    if any(w in BOILERPLATE_WORDS for w in words):
        return -2.0 if len(words) == 1 else -1.0
    return 0.5 if any(w in CONTENT_WORDS for w in words) else 0.0


def _said(name: str, rest: str, within_content: bool) -> float:
    """What an element says of its text."""
    own = -2.0 if name in SAYS_BOILERPLATE or name == "header" and not within_content else 1.0 if name in SAYS_CONTENT else 0.0
    names = [n for value in (_SAYING.findall(rest) if rest and name not in UNSAYING else ()) for n in _CLASSES(value)]
    votes = [_vote(n) for n in (names[:1] if name == "article" else names)]
    return own + min(votes, default=0.0) if min(votes, default=0.0) < 0 else own + max(votes, default=0.0)


def _hint(outer: float, said: float) -> float:
    """The hint within an element, from that around it and what it says itself."""
    return max(-MOST_HINT, min(MOST_HINT, said + outer / 2)) if said else outer


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    out: list[Block] = []
    # open containers: name, number, the hint within
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]
    open_names: dict[str, int] = {}
    made, parts, linked, in_link, heading, own = 0, [], 0, False, False, 0.0
    link_depth = 0  # containers around the open link

    def close() -> None:
        nonlocal parts, linked, heading, in_link, own
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), heading, stack[-1][1], len(stack), _hint(stack[-1][2], own)))
            parts, linked = [], 0
        heading, own = False, 0.0

    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        chunk = page[at : found.start() if found else size]
        if chunk:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            parts.append(chunk)
            if in_link:
                linked += len(chunk)
        if not found:
            break
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        ends, rest = found["end"] or found["end2"], found["rest"] or found["rest2"]
        if name in UNSEEN:
            if not ends:
                if name == "form":
                    close()
                closed = (_BODY if name == "head" else _CLOSERS[name]).search(page, at)
                if closed or name in RAW:  # of others a tag that nothing closes hides nothing
                    at = closed.end() if closed else size
            continue
        if name == "a":
            in_link, link_depth = not ends, len(stack)
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()  # a link may hold blocks
            if name not in CONTAINERS:
                if not ends:
                    heading, own = name in HEADINGS, _said(name, rest, stack[-1][2] > 0)
            elif not ends:
                made += 1
                stack.append((name, made, _hint(stack[-1][2], _said(name, rest, stack[-1][2] > 0))))
                open_names[name] = open_names.get(name, 0) + 1
            elif open_names.get(name):
                while True:
                    top = stack.pop()[0]
                    open_names[top] -= 1
                    if top == name:
                        break
                in_link = in_link and len(stack) >= link_depth
    close()
    return out


def min_cut(content: list[int], boilerplate: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it stays with the content terminal at the least cut.

    A node costs content[i] if it is parted from that terminal, boilerplate[i] if from the
    other; an edge (i, j, w) costs w if its ends are parted.  Of several least cuts the one
    with the most content is taken.
    """
    n = len(content)
    excess = [c - b for c, b in zip(content, boilerplate)]  # what the two direct edges leave
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for i, j, w in edges:
        near[i].append(len(to))
        near[j].append(len(to) + 1)
        to += [j, i]
        room += [w, w]
    while True:
        # distances to the sinks, over edges with room; then paths from the sources along them
        level = [0 if e < 0 else -1 for e in excess]
        queue = deque(i for i in range(n) if excess[i] < 0)
        while queue:
            j = queue.popleft()
            for e in near[j]:
                i = to[e]
                if level[i] < 0 and room[e ^ 1] > 0:
                    level[i] = level[j] + 1
                    queue.append(i)
        if not any(excess[i] > 0 and level[i] >= 0 for i in range(n)):
            return [d < 0 for d in level]
        turn = [0] * n
        for source in range(n):
            while excess[source] > 0 and level[source] >= 0:
                path, i = [], source
                while excess[i] >= 0:
                    while turn[i] < len(near[i]):
                        e = near[i][turn[i]]
                        if room[e] > 0 and level[to[e]] == level[i] - 1:
                            break
                        turn[i] += 1
                    else:
                        level[i] = -2 if i == source else n + 1  # a dead end in this round
                        if not path:
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        turn[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if not path:
                    break
                flow = min(excess[source], -excess[i], min(room[e] for e in path))
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                excess[source] -= flow
                excess[i] += flow


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between blocks that follow each other on the page or within their parent."""
    edges, last = [], {}
    for j, block in enumerate(found):
        before = last.get(block.parent)
        for i in {j - 1, before} - {None, -1}:
            apart = 1 + abs(found[i].depth - block.depth) + (found[i].parent != block.parent) + (i != j - 1)
            edges.append((i, j, int(UNITS * SMOOTH / apart)))
        last[block.parent] = j
    return edges


def costs(found: list[Block], weights: np.ndarray) -> tuple[list[int], list[int]]:
    """What it costs to call each block boilerplate, and content."""
    odds = np.array([b.features() for b in found]) @ weights + HINT * np.array([b.says for b in found])
    whole = lambda x: np.rint(np.minimum(x, 1_000) * UNITS).astype(int).tolist()
    return whole(np.logaddexp(0, odds)), whole(np.logaddexp(0, -odds))


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    kept = min_cut(*costs(found, weights), smoothness(found))
    return "\n\n".join(b.text for b, keep in zip(found, kept) if keep)


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the classifier, by Newton's method from the PRIOR on a bounded sample of pages."""
    rows = pages.count()
    slots = 1 << 30
    chosen = F.pmod(F.xxhash64("page_id", "html"), F.lit(slots)) < min(slots, slots * train_pages // max(1, rows))

    @F.arrow_udf("array<array<double>>")
    def seeds(texts: pa.Array) -> pa.Array:
        kinds = [[[float(b.says > 0), *b.features()] for b in blocks(t.as_py() or "") if b.says] for t in texts]
        return pa.array(kinds, pa.list_(pa.list_(pa.float64())))

    # rows that repeat are chosen together, and are one here: so the hash bounds their number
    sample = pages.where(F.col("html").isNotNull()).where(chosen).select("page_id", "html").distinct().select(F.explode(seeds("html")).alias("x"))
    # blocks of equal features are one row with a weight; features are rounded, so a page of any length has a bounded number
    rounded = F.transform("x", lambda v: F.round(v, 1))
    data = sorted((*r["x"], r["n"]) for r in sample.groupBy(rounded.alias("x")).agg(F.count(F.lit(1)).alias("n")).collect())
    table = np.array(data) if data else np.zeros((0, 2 + len(PRIOR)))
    y, x, n = table[:, 0], table[:, 1:-1], table[:, -1]
    if min(n @ y, n @ (1 - y)) < LEAST_SEEDS:
        return PRIOR
    n = n * np.where(y > 0, 0.5 * n.sum() / (n @ y), 0.5 * n.sum() / (n @ (1 - y)))  # both kinds weigh alike
    weights = PRIOR.copy()
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        pull = 0.01 * n.sum()
        slope = x.T @ (n * (p - y)) + pull * (weights - PRIOR)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(PRIOR))
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def extract(page: Column, weights: np.ndarray) -> Column:
    """string: the main text of each page."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return texts(page)


def main_texts(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text: one row for each row of `pages` (columns page_id, url, html)."""
    return pages.select("page_id", "url", extract(F.col("html"), train(pages, train_pages)).alias("text"))
