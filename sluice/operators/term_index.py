"""Large term lists: terms are found by hashed prefixes in the tasks, longer lists by their rarest runs of characters.

``detect.term_hits`` writes a short list into the plan. A list of many thousands is a table instead. Up to LIST_ROWS terms are
sent to the tasks, which follow all places of a text through the terms' prefixes at once; texts stay where they are. Beyond
it each term is indexed by one run of GRAM characters, the one that a sample of the texts holds least; texts' runs are joined
to the index, and only the terms that come out are looked for in a text. Which way is taken and which run stands for a term
changes the work, never the result. The plan is the same for any list."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import text as X
from sluice.sources.scratch import staged

#: Characters of an index run; shorter terms are indexed whole.
GRAM = 4
#: Texts whose runs are counted to pick the rarest, and index rows that are broadcast at most.
SAMPLE, BROADCAST_ROWS = 10_000, 2_000_000
#: Terms sent to the tasks at most, characters of a term that are followed before it is looked for as a whole, and characters
#: of texts that are worked on at once.
LIST_ROWS, DEPTH, CHUNK = 200_000, 32, 1 << 20
_STEP, _END = np.uint64(0x9E3779B97F4A7C15), 0x110000


def _mixed(c: np.ndarray) -> np.ndarray:
    x = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Terms:
    """Terms by their hashed prefixes. rows: (place, needle, whole); whole: only as a whole word."""

    def __init__(self, rows: list[tuple[int, str, bool]]):
        self.needles = sorted({n for _, n, _ in rows})
        number = {n: k for k, n in enumerate(self.needles)}
        self.sizes = np.array([len(n) for n in self.needles], np.int64)
        self.places = {whole: self._lists([(number[n], p) for p, n, w in rows if w == whole]) for whole in (False, True)}
        depth = min(int(self.sizes.max(initial=0)), DEPTH)
        prefix = np.zeros((len(self.needles), depth), np.uint64)
        h = np.zeros(len(self.needles), np.uint64)
        chars = np.zeros((len(self.needles), depth), np.uint64)
        for k, n in enumerate(self.needles):
            c = _codes(n[:DEPTH])
            chars[k, : len(c)] = c
        for d in range(depth):
            h = h * _STEP + _mixed(chars[:, d])
            prefix[:, d] = h
        self.levels = []
        for d in range(depth):
            going, ends = prefix[self.sizes > d, d], np.flatnonzero(np.minimum(self.sizes, DEPTH) == d + 1)
            bits = max(10, int(len(going) * 16).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[going >> np.uint64(64 - bits)] = True
            order = ends[np.argsort(prefix[ends, d], kind="stable")]
            self.levels.append((np.uint64(64 - bits), seen, prefix[order, d], order))

    def _lists(self, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where each needle's places begin, and the places."""
        pairs = sorted(set(pairs))
        at = np.searchsorted(np.array([k for k, _ in pairs], np.int64), np.arange(len(self.needles) + 1))
        return at, np.array([p for _, p in pairs], np.int64)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of what texts hold, distinct, by text."""
        starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        c = np.concatenate([[_END], *(x for t in texts for x in (_codes(t), [_END]))]).astype(np.uint64)
        word = np.zeros(128, bool)
        word[[i for i in range(128) if chr(i).isalnum() or chr(i) == "_"]] = True
        is_word = (c < 128) & word[np.minimum(c, np.uint64(127)).astype(np.int64)]
        mixed = _mixed(c)
        at, h, hits = np.arange(1, len(c)), np.zeros(len(c) - 1, np.uint64), []
        for d, (shift, seen, ends, order) in enumerate(self.levels):
            inside = at + d < len(c)
            if not inside.all():
                at, h = at[inside], h[inside]
            h = h * _STEP + mixed[at + d]
            keep = np.flatnonzero(seen[h >> shift])
            at, h = at[keep], h[keep]
            if len(ends) and len(h):
                lo, hi = np.searchsorted(ends, h, "left"), np.searchsorted(ends, h, "right")
                n = hi - lo
                own = np.repeat(np.arange(len(h)), n)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                hits.append((at[own], order[lo[own] + nth]))
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, needle = (np.concatenate(x) for x in zip(*hits, strict=True))
        text = np.searchsorted(starts, at, "right") - 1
        end = np.minimum(at + self.sizes[needle], len(c) - 1)
        alone = ~is_word[at - 1] & ~is_word[end] | (self.sizes[needle] > DEPTH)
        out = []
        for whole, ok in ((False, slice(None)), (True, alone)):
            first, places = self.places[whole]
            if not len(places):
                continue
            key, where = np.unique(text[ok] * len(self.needles) + needle[ok], return_index=True)
            t, k = np.divmod(key, max(len(self.needles), 1))
            use = first[k + 1] > first[k]
            t, k, p = t[use], k[use], (at[ok][where] - starts[np.minimum(text[ok][where], len(starts) - 1)])[use]
            good = np.array([self._holds(texts[a], self.needles[b], q, whole) for a, b, q in zip(t.tolist(), k.tolist(), p.tolist(), strict=True)], bool)
            t, k = t[good], k[good]
            n = first[k + 1] - first[k]
            own = np.repeat(np.arange(len(k)), n)
            out.append((t[own], places[first[k][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]))
        t, p = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
        by = np.lexsort((p, t))
        t, p = t[by], p[by]
        new = np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])] if len(t) else np.empty(0, bool)
        return t[new], p[new]

    def _holds(self, text: str, needle: str, at: int, whole: bool) -> bool:
        """Whether the term stands at that place, or else anywhere: hashes may lie, and long terms were followed in part."""
        if len(needle) <= DEPTH and text.startswith(needle, at):
            return True
        return bool(re.search(rf"(?<!\w){re.escape(needle)}(?!\w)", text, re.ASCII)) if whole else needle in text


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _in_tasks(docs: DataFrame, id_col: str, text: str, terms: Terms) -> DataFrame:
    """Distinct (id, place); one row an id shuffles, for ids that come again."""
    src = docs.select(id_col, F.col(text).alias("_text"))
    ctx = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = ctx.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                t, p = known.found([x or "" for x in texts[lo:hi]])
                if len(t):
                    rows, n = np.unique(t, return_counts=True)
                    places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(p, pa.int64()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows + lo)), places], names=[id_col, "places"])

    found = src.mapInArrow(run, src.select(id_col, F.lit(None).cast("array<long>").alias("places")).schema)
    return found.groupBy(id_col).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")).select(id_col, F.explode("places").alias("place"))


def _runs(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def text_runs(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of the given lengths; none of a null text."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(_runs(text, n), F.array().cast("array<string>")) for n in sizes])))


def rarest_runs(needles: DataFrame, texts: DataFrame, sizes: list[int], sample: int = SAMPLE) -> DataFrame:
    """place, run: one run a needle. needles: (place, needle); texts: (text)."""
    n = F.length("needle")
    of = F.when(n >= GRAM, _runs(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    runs = needles.select("place", F.explode(F.array_distinct(of)).alias("run"))
    rows = texts.count()
    some = texts if rows <= sample else texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(sample / rows * (1 << 20)) + 1)
    counts = some.select(F.explode(text_runs(F.col("text"), sizes)).alias("run")).join(runs.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(counts, "run", "left").groupBy("place").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))["run"].alias("run"))


def found_places(docs: DataFrame, id_col: str, text: str, needles: DataFrame) -> DataFrame:
    """Distinct (id, place) of needles that a text holds. needles: (place, needle, whole), whole: only as a whole word."""
    needles = staged(needles.where(F.length("needle") > 0), "needles")
    if needles.count() <= min(LIST_ROWS, BROADCAST_ROWS):
        return _in_tasks(docs, id_col, text, Terms([(r.place, r.needle, bool(r.whole)) for r in needles.collect()]))
    short = [r[0] for r in needles.where(F.length("needle") < GRAM).select(F.length("needle")).distinct().collect()]  # fewer than GRAM
    sizes = sorted([*short, GRAM])
    index = staged(rarest_runs(needles, docs.select(F.col(text).alias("text")), sizes), "term-index")
    small = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    runs = docs.select(id_col, F.explode(text_runs(F.col(text), sizes)).alias("run"))
    may = staged(runs.join(small, "run").select(id_col, "place").distinct(), "term-candidates")
    rows = docs.select(id_col, F.col(text).alias("_text")).join(may, id_col).join(needles, "place")
    word = F.regexp_like("_text", F.concat(F.lit(r"(?<!\w)\Q"), "needle", F.lit(r"\E(?!\w)")))
    return rows.where(F.when(F.col("whole"), word).otherwise(F.contains("_text", "needle"))).select(id_col, "place").distinct()


def term_list_hits(docs: DataFrame, id_col: str, norm_lower: str | None, raw_lower: str | None, terms: DataFrame, fold: dict[str, str] | None = None) -> DataFrame:
    """id and hits, array<struct<place, value, rule_id>> in list order, of rows that hold a term of the list.

    terms: (place, value, rule_id), place a number in the list. A term is found where the normalized text contains its
    normalized form; in the raw text plain tokens count as whole words, others anywhere. A channel that is None is off;
    null texts hold nothing; rows of equal id are one; an empty or null term, or one that normalization leaves empty, isn't
    found in that channel."""
    known = staged(X.with_hard_normalized(terms.select("place", "value", "rule_id").where("value is not null"), "value", "_norm", fold), "terms")
    parts = []
    if norm_lower:
        parts.append(found_places(docs, id_col, norm_lower, known.select("place", F.lower("_norm").alias("needle"), F.lit(False).alias("whole"))))
    if raw_lower:
        parts.append(found_places(docs, id_col, raw_lower, known.select("place", F.lower("value").alias("needle"), F.col("value").rlike("^[A-Za-z0-9_-]+$").alias("whole"))))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()
    hits = found.join(known.select("place", "value", "rule_id"), "place")
    return hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "value", "rule_id"))).alias("hits"))
