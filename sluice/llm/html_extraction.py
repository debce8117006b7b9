"""Operator 6: main text of pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and text nodes. A text node has features: the elements it stands in, the words of
their class, id and role, its innermost block, and its block's length and share of links. A logistic model of these gives
every word a score, positive for main text; every tag scores negative. One linear scan finds the contiguous stretch of the
highest sum, which alone decides where the text begins and ends. Boilerplate within it is found by the same kind of scan with
signs turned: all maximal stretches of negative words between text that stays, in which a word of text counts KEEP times, so
that no paragraph is lost between two adverts; those of at least LEAST_CUT are cut, weaker ones stay.

Weights are fitted on labelled pages, those whose publisher marked exactly one article or main element: words inside against
words outside. The mark is a label only; no feature says whether a node stands in one, so pages without it are read alike.
The fit starts from PRIOR (what common element and class names usually hold) and departs from it as far as pages say
otherwise; nodes inside a marked element that the prior calls boilerplate (adverts and comments within articles) have no sure
label and aren't fitted, nor are those of over MOST_FEATURES features. A tag costs more the more often it stands outside.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined results: a null or empty page, or one without visible words, has empty text; a page on which the fitted weights find
nothing is read by PRIOR alone; elements left open end with their parent or at the next article; equal scores go to the
first stretch; repeated rows each give a row; without labelled pages PRIOR holds; columns that clash with the result's names
are no inputs.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm._common import hash_sample, map_arrow

#: Labelled pages counted at most (by a hash of the id).
SAMPLE_PAGES = 5_000
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|object|math|select"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)/?>|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that are part of a running line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks of running text; what a node stands in is told by the elements around them.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption br hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words in class, id and role, that seldom hold main text.
BOILERPLATE = "nav footer aside form button menu dialog select header".split()
BOILERPLATE_NAMES = "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer masthead menu menubar modal nav navbar navigation newsletter notice popup promo promoted promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
#: Weights before any page is seen.
BOILER = 8.0
PRIOR = {"bias": 0.3, "block:p": 1.5, "block:li": -0.5, "links:most": -5.0, "links:some": -0.3, "short": -0.3, "nested": -BOILER, "heading": BOILER} | {f"in:{t}": -BOILER for t in BOILERPLATE} | {f"name:{w}": -BOILER for w in BOILERPLATE_NAMES}
#: Words that the labelled pages weigh together; the prior's precision is that of one.
EVIDENCE = 10_000.0
MOST = 4.0
#: What a word of text counts against a cut, the least score of a cut, and the features of a node that is fitted.
KEEP, LEAST_CUT, MOST_FEATURES = 4.0, 2.0, 64


class Node:
    """An open element. ``own`` are the features that no element around it has; iterating gives all of them."""

    __slots__ = ("tag", "parent", "own", "article", "link", "header", "nested", "block", "base")

    def __init__(self, tag: str, parent: Node | None = None, own: tuple[str, ...] = ()):
        def above(name):
            return parent is not None and getattr(parent, name)

        self.tag, self.parent, self.own, self.base = tag, parent, own, None
        self.article, self.link, self.header = above("article") or tag in ("article", "main"), above("link") or tag == "a", above("header") or tag == "header"
        self.nested = above("nested") or tag == "article"
        self.block = tag if tag not in INLINE else above("block") or "body"

    def __iter__(self):
        node = self
        while node is not None:
            yield from node.own
            node = node.parent

    def weigh(self, w: dict[str, float]) -> float:
        """Bias and weights of all features; elements around it are weighed once a page."""
        todo, node = [], self
        while node is not None and node.base is None:
            todo.append(node)
            node = node.parent
        base = w["bias"] if node is None else node.base
        for node in reversed(todo):
            base = node.base = base + sum(w.get(f, 0.0) for f in node.own)
        return base


def _name(word: str) -> str:
    return f"name:{word if len(word) <= 32 else format(zlib.crc32(word.encode()), '08x')}"


def tokens(page: str):
    """(kind, value, node, block): kind 't' a tag with its name, 'w' a text node with where it stands, 'b' a block's edge."""
    stack, active, opened = [Node("body")], set(), {}

    def leave(i: int) -> None:
        for n in stack[i:]:
            active.difference_update(n.own)
            opened[n.tag] -= 1
        del stack[i:]

    for m in _TOKEN.finditer(page):
        s = m.group()
        if s[0] != "<" or s == "<":
            yield "w", s, stack[-1], stack[-1].block
            continue
        tag = m[3] or m[6]
        if tag is None:
            if m[1]:
                yield "t", m[1].lower(), None, None
                if m[1].lower() not in INLINE:
                    yield "b", "", None, None
            continue
        tag, closing, attrs = tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag not in INLINE:
            yield "b", "", None, None
        yield "t", tag, None, None
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    leave(i)
                    break
                if stack[i].tag in ("article", "main", "body") and tag in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag in ("article", "main") and not stack[-1].article:
            while len(stack) > 1 and stack[-1].tag in ("nav", "header", "ul", "ol", "li", "p", "a", "footer", "aside"):
                leave(len(stack) - 1)  # left open
        elif tag not in INLINE and stack[-1].tag == "p" or tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack[-1].tag == tag:
            if len(stack) > 1:
                leave(len(stack) - 1)
        new = set()
        if tag not in INLINE and tag not in TEXT_BLOCKS and tag not in ("html", "body", "article", "main"):
            new.add(f"in:{tag}")
        if attrs and tag not in ("html", "body"):
            new.update(_name(w) for g in _NAMES.findall(attrs) for w in _WORDS.findall("".join(g).lower()))
        if tag == "article" and stack[-1].nested:  # reader comments
            new.add("nested")
        stack.append(Node(tag, stack[-1], tuple(new - active)))
        active |= new
        opened[tag] = opened.get(tag, 0) + 1


def read_blocks(page: str) -> list[tuple]:
    """The page as a sequence: ('t', tag), ('w', text, words, features, in a marked article) and ('b',) at blocks' edges."""
    out, held = [], []

    def close():
        total = sum(n for _, n, _, _ in held)
        linked = sum(n for _, n, node, _ in held if node.link)
        shape = () if not linked else ("links:most",) if 2 * linked > total else ("links:some",)
        shape += ("short",) if total < 4 else ()
        for at, n, node, block in held:
            extra = (f"block:{block}", *shape, *(("heading",) if node.header and block in ("h1", "h2") else ()))
            out[at] = ("w", out[at], n, (node, extra), node.article)
        held.clear()

    for kind, value, node, block in tokens(page):
        if kind == "w":
            held.append((len(out), len(value.split()), node, block))
            out.append(value)
        elif kind == "b":
            close()
            out.append(("b",))
        else:
            out.append(("t", value))
    close()
    return out


def page_counts(page: str) -> dict[str, list[int]] | None:
    """Words inside and outside the marked article by their features, and tags likewise; None for an unlabelled page."""
    if len(re.findall(r"<article\b", page, re.I)) + len(re.findall(r"<main\b", page, re.I)) != 1:
        return None
    out: dict[str, list[int]] = {}
    inside = False
    for x in read_blocks(page):
        if x[0] == "w" and x[2]:
            features = [*x[3][0], *x[3][1]]
            if len(features) > MOST_FEATURES:
                continue
            if x[4] and any(PRIOR.get(f, 0) <= -BOILER for f in features) and "heading" not in features:
                continue
            out.setdefault("w " + " ".join(sorted(features)), [0, 0])[not x[4]] += x[2]
        elif x[0] == "t":
            if x[1] in ("article", "main"):
                inside = not inside
            out.setdefault(f"t {x[1]}", [0, 0])[not inside] += 1
    return out


def fit_weights(counts: dict[str, tuple[int, int]], steps: int = 400) -> dict[str, float]:
    """Weights of features, 'bias' and 'tag:' costs. Minimises the logistic loss of the words plus half the squared distance
    from PRIOR, by accelerated gradient steps under a diagonal bound of the curvature."""
    rows = sorted((k[2:].split(), *v) for k, v in counts.items() if k[0] == "w")
    names = sorted({f for r in rows for f in r[0]} | {"bias"})
    place = {f: i for i, f in enumerate(names)}
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    weights = dict(PRIOR)
    if rows:
        at = np.concatenate([np.full(len(r[0]) + 1, i) for i, r in enumerate(rows)])
        ids = np.concatenate([[*(place[f] for f in r[0]), place["bias"]] for r in rows]).astype(np.int64)
        hit, miss = (np.array([r[k] for r in rows], float) for k in (1, 2))
        scale = EVIDENCE / max(1.0, (hit + miss).sum())
        hit, miss = hit * scale, miss * scale
        size = np.bincount(at)
        bound = 1 + 0.25 * np.bincount(ids, ((hit + miss) * size)[at], len(names))
        w = v = prior.copy()
        for k in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(at, v[ids], len(rows)), -35, 35)))
            g = np.bincount(ids, ((hit + miss) * p - hit)[at], len(names)) + v - prior
            new = v - g / bound
            v, w = new + k / (k + 3) * (new - w), new
        weights |= {f: float(w[i]) for f, i in place.items()}
    tags = {k[2:]: v for k, v in counts.items() if k[0] == "t"}
    return weights | {f"tag:{t}": -(0.1 + (o + 0.5) / (i + o + 1)) for t, (i, o) in tags.items()}


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous stretch of the highest positive sum, the first one at ties; (0, 0) if none is positive."""
    best = total = 0.0
    start, span = 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, span = total, (start, i + 1)
    return span


def all_stretches(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal stretches of positive sum, in order: each begins and ends with what adds to it, and none
    can be joined with its neighbours to a higher sum than both have."""
    held: list[tuple] = []  # start, end, sum before, sum at the end, the nearest earlier one that begins lower
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low = i, before
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= total:
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
        held.append((start, i + 1, low, total, j))
    return [(s, e, high - low) for s, e, low, high, _ in held]


def cuts(words: list[int], container: list[float]) -> list[bool]:
    """Which entries of a stretch are boilerplate between text that stays. words: of each entry, 0 for tags; container: its
    score a word."""
    drop = [False] * len(words)
    text = [i for i, (n, z) in enumerate(zip(words, container, strict=True)) if n and z > 0]
    if text:
        first, last = text[0], text[-1]
        turned = [-n * max(-MOST, min(MOST, z)) * (KEEP if z > 0 else 1.0) for n, z in zip(words[first:last], container[first:last], strict=True)]
        for s, e, total in all_stretches(turned):
            if total >= LEAST_CUT:
                drop[first + s : first + e] = [True] * (e - s)
    return drop


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    w = PRIOR if weights is None else weights
    seq = read_blocks(page)
    scores, container = [], []
    for x in seq:
        score = z = 0.0
        if x[0] == "w":
            node, own = x[3]
            z = node.weigh(w) + sum(w.get(f, 0.0) for f in own)
            score = x[2] * max(-MOST, min(MOST, z))
            z -= w["short"] if "short" in own else 0.0  # a short line in a good place is text
        elif x[0] == "t":
            score = w.get(f"tag:{x[1]}", -0.3)
        scores.append(score)
        container.append(z)
    start, end = best_stretch(scores)
    seq = seq[start:end]
    drop = cuts([x[2] if x[0] == "w" else 0 for x in seq], container[start:end])
    blocks, line = [], []
    for x, gone in zip(seq, drop, strict=True):
        if x[0] == "b":
            blocks.append("".join(line))
            line = []
        elif x[0] == "w":
            if not gone:
                line.append(x[1])
        elif x[1] == "br":
            line.append(" ")
    blocks.append("".join(line))
    text = " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
    return text if text or weights is None else extract(page)


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``rows`` pages, in the order of a hash of their ids."""
    known = hash_sample(pages.where(F.col(html_col).isNotNull()), [id_col], rows)
    sample = known.select(F.col(html_col).cast("string").alias("h"), F.xxhash64(F.col(id_col)).alias("o")).orderBy("o", F.xxhash64("h")).limit(rows).select("h")

    def run(b):
        out: dict[str, list[int]] = {}
        for p in b.column(0).to_pylist():
            for k, (i, o) in (page_counts(p) or {}).items():
                c = out.setdefault(k, [0, 0])
                c[0] += i
                c[1] += o
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), *(pa.array([c[k] for c in out.values()], pa.int64()) for k in (0, 1))], names=["k", "i", "o"])

    got = map_arrow(sample, run, "k string, i long, o long").groupBy("k").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return fit_weights({r.k: (r.i, r.o) for r in got.collect()})  # of at most ``rows`` pages


def extract_pages(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, kept columns, text and n_chars of every page."""
    src = pages.select(F.col(html_col).cast("string").alias("_html"), id_col, *keep)
    schema = T.StructType([*src.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(b):
        texts = [extract(p, weights) for p in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return map_arrow(src, run, schema)
