"""Shared by the duplicate finders: hashed word windows, texts of candidate pairs, connected components."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import discard, stage

#: Ids of this many documents at most are broadcast to pick their texts; beyond it the texts shuffle.
BROADCAST_IDS = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: ASCII white space, by which words are cut, and a value of each byte (odd, so that no byte counts for nothing).
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _P) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
#: Bytes of a text that are hashed at once; a longer word is hashed whole.
PIECE = 1 << 16


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE modulo 2**64 and their inverses."""
    up, down = (np.cumprod(np.full(n, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def _piece_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Polynomials of the words' bytes: differences of a running sum over the piece, moved to power 0 of each word's begin; and
    where the words begin."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[b]))
    start, end = edges[0::2], edges[1::2]
    up, down = _powers(PIECE + 2) if len(b) <= PIECE + 2 else _powers.__wrapped__(len(b))
    total = np.cumsum(_BYTE[b] * up[: len(b)])
    return _mix((total[end] - total[start]) * down[start]), start


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lower-cased; words are cut at ASCII white space."""
    out, at = [], 0
    while text and at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        out.append(_piece_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, np.uint64)


def many_word_hashes(texts: Sequence[bytes | None]) -> list[np.ndarray]:
    """word_hashes of each text; short texts are hashed together, up to a piece at once."""
    out: list[np.ndarray] = []
    while len(out) < len(texts):
        end, ends = len(out), []
        while end < len(texts) and (ends[-1] if ends else 0) + len(texts[end] or b"") < PIECE:
            ends.append((ends[-1] if ends else 0) + len(texts[end] or b"") + 1)
            end += 1
        if ends:
            h, start = _piece_hashes(b" ".join(t or b"" for t in texts[len(out) : end]))
            out += np.split(h, np.searchsorted(start, ends[:-1]))
        else:
            out.append(word_hashes(texts[end]))
    return out


def _runs(w: np.ndarray, k: int) -> np.ndarray:
    """Polynomials of all runs of k words, those of an even number from runs of half as many."""
    n = len(w) - k + 1
    if k % 2 or k < 8:
        h = w[:n].copy()
        for i in range(1, k):
            h *= _P
            h += w[i : i + n]
        return h
    half = _runs(w, k // 2)
    return half[:n] * np.uint64(pow(int(_P), k // 2, 1 << 64)) + half[k // 2 :]


def window_hashes(w: np.ndarray, k: int, mixed: bool = True) -> np.ndarray:
    """Hashes of all k-word windows; of the whole sequence, if it has fewer words but any. Without ``mixed`` their bits aren't
    spread, which is enough to compare them."""
    if not len(w):
        return w
    if 8 <= k <= len(w):
        h = _runs(w, k) + np.uint64(k * pow(int(_P), k, 1 << 64) % (1 << 64))
        return _mix(h) if mixed else h
    n = max(1, len(w) - k + 1)
    h = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for i in range(min(k, len(w))):
        h *= _P
        h += w[i : i + n]
    return _mix(h) if mixed else h


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct window hashes."""
    return np.unique(window_hashes(word_hashes(text), k))


def attach_texts(pairs: DataFrame, docs: DataFrame, *keep: str) -> DataFrame:
    """pairs: staged (doc, ref, keep); docs: (id, text). Returns ref, doc, ref_text, doc_text, keep, rows of a ref together
    where Spark merges; hot refs are split by adaptive execution."""
    ids = stage(pairs.select(F.col("doc").alias("id")).unionByName(pairs.select(F.col("ref").alias("id"))).distinct(), "ids")
    texts = docs.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= BROADCAST_IDS else docs
    one = pairs.join(texts.select(F.col("id").alias("doc"), F.col("text").alias("doc_text")), "doc")
    return one.join(texts.select(F.col("id").alias("ref"), F.col("text").alias("ref_text")), "ref").select("ref", "doc", "ref_text", "doc_text", *keep)


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """edges: (doc, ref) of distinct ids. Returns (id, component), the smallest id reachable, for every id in an edge.

    Each round an id takes the smallest label among its neighbours' and its own, then its label's label; rounds end
    when none changes. Labels are written to the shared folder each round, in place of the round before."""
    both = stage(edges.select(F.col("doc").alias("a"), F.col("ref").alias("b")).unionByName(edges.select(F.col("ref").alias("a"), F.col("doc").alias("b"))).distinct(), f"{name}-edges")
    held = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    for k in range(1, max_rounds + 1):
        near = both.join(held.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = held.select("id", "component").join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        new = stage(new, f"{name}-{k}a")
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("root"))
        then = stage(new.join(jump, "component", "left").select("id", "old", F.coalesce("root", "component").alias("component")), f"{name}-{k}b")
        changed = not then.where(F.col("component") != F.col("old")).isEmpty()
        discard(held, new)
        held = then
        if not changed:
            discard(both)
            return held.select("id", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
