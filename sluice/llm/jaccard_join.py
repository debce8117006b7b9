"""Operator 5: n-gram Jaccard self-join by prefix trees, and its link components.

A document is its set of distinct five-word windows. Equal sets are one class, whose smallest id stands for it. In a
global order of all windows, sets of similarity 0.8 or more share one of their first n - ceil(0.8 n) + 1 members.
Windows that many documents share come last in that order (by counts over the whole corpus in a fixed number of
buckets; any order gives the same links), so that common passages aren't candidates.

The sets that share a first member with one reference set are a partition of the join: the reference is the smallest id that
holds the member, and what it connects needs no further pairs; members that still join different components give their
remaining pairs as partitions of a second round. A partition's sets, members in the global order, are stored in a trie whose
unbranched paths are one node. The reference traverses it from the root: a node's overlap with it is counted once for all
sets below, and a subtree is left as soon as the members that remain, of its largest set or of the reference, can't reach the
overlap that its smallest set needs. So every pair is decided exactly.

Defined results: null, empty and wordless texts have 0 shingles and are linked with nothing; texts of 1 to 4 words
are one shingle; rows of equal id count as one document with each of their texts; a null id keeps a null component; an empty
table gives no rows; columns that clash with inner names are no inputs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import discard, join_bounded, map_arrow, stage
from sluice.llm._pairs import attach_texts, components, shingle_set

WORDS = 5
#: Similarity as a ratio: 100 * intersection >= 80 * union.
PERCENT = 80
BUCKET_BITS = 16


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def bucket_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many (document, window) pairs fall into each of 2**BUCKET_BITS buckets, over all documents."""

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t:
                    np.add.at(total, (shingle_set(t, words) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def late_buckets(counts: np.ndarray) -> np.ndarray:
    """0 for ordinary buckets, else the count: more than chance gives a bucket of unrelated windows."""
    mean = counts.mean()
    return np.where(counts > mean + 6 * np.sqrt(mean) + 32, counts, 0)


def signatures(docs: DataFrame, late: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n, digest of the set, and the set's first members in the global order."""
    id_type = docs.schema["id"].dataType.simpleString()
    ctx = docs.sparkSession.sparkContext.broadcast(late)  # 2**BUCKET_BITS numbers

    def run(b):
        order, n, digests, sigs = ctx.value, [], [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            s = shingle_set(t, words)
            n.append(len(s))
            digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            p = prefix_length(len(s), percent)
            weight = order[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            first = s[weight == 0]
            if len(first) < p:  # s is sorted, so a stable sort by weight is the global order
                first = s[np.argsort(weight, kind="stable")]
            sigs.append(first[:p].view(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "n", "digest", "sig"])

    return map_arrow(docs.select("id", "text"), run, f"id {id_type}, n long, digest binary, sig array<long>")


def in_order(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """A sorted set's members in the global order: by their bucket's weight, then by value."""
    return s[np.argsort(late[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")]


class Trie:
    """Prefix tree of sets given as ascending places in one order; a node is a path without branches.

    Nodes are tuples (path, depth at its end, smallest and largest size of the sets below, sets that end here, children)."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.roots: list[tuple] = []
        todo = [(0, len(order), 0, self.roots)]
        while todo:
            lo, hi, depth, out = todo.pop()
            while lo < hi:
                # the sets that share the member at this depth stand together
                first = sets[order[lo]]
                end = lo + 1
                while end < hi and len(sets[order[end]]) > depth and len(first) > depth and sets[order[end]][depth] == first[depth]:
                    end += 1
                last = sets[order[end - 1]]
                m = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:m] != last[depth:m])
                stop = depth + int(differ[0]) if len(differ) else m
                below = order[lo:end]
                sizes = [len(sets[k]) for k in below]
                own = 0
                while own < len(below) and sizes[own] == stop:
                    own += 1
                children: list[tuple] = []
                out.append((first[depth:stop], stop, min(sizes), max(sizes), below[:own], children))
                if own < len(below):
                    todo.append((lo + own, end, stop, children))
                lo = end

    def similar(self, x: np.ndarray, percent: int = PERCENT) -> list[int]:
        """Numbers of the sets that are similar to x, whose places are in the same order."""
        found, todo = [], [(node, 0) for node in self.roots]
        n = len(x)
        while todo:
            (path, depth, least, most, own, children), overlap = todo.pop()
            if len(path):
                at = np.searchsorted(x, path)
                overlap += int((x[np.minimum(at, n - 1)] == path).sum())
                rest = n - int(np.searchsorted(x, path[-1], "right"))
            else:
                rest = n
            if overlap + min(most - depth, rest) < -(-percent * (n + least) // (100 + percent)):
                continue
            found += [k for k in own if overlap >= -(-percent * (n + depth) // (100 + percent))]
            todo += [(child, overlap) for child in children]
        return found


def trie_links(x: np.ndarray, sets: list[np.ndarray], late: np.ndarray, percent: int = PERCENT) -> list[bool]:
    """Which of the sets are similar to x, by a trie of them in the global order."""
    found = [False] * len(sets)
    filled = [k for k, s in enumerate(sets) if len(s)]
    if len(x) and filled:
        members = np.unique(np.concatenate([x, *(sets[k] for k in filled)]))
        rank = np.empty(len(members), np.int64)
        rank[np.searchsorted(members, in_order(members, late))] = np.arange(len(members))
        places = lambda s: np.sort(rank[np.searchsorted(members, s)])
        for k in Trie([places(sets[k]) for k in filled]).similar(places(x), percent):
            found[filled[k]] = True
    return found


def similar_pairs(pairs: DataFrame, docs: DataFrame, late: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of the staged pairs (doc, ref) whose sets are similar."""
    types = [pairs.schema[c].dataType.simpleString() for c in ("doc", "ref")]
    ctx = docs.sparkSession.sparkContext.broadcast(late)  # 2**BUCKET_BITS numbers

    def run(b):
        ids, ref_texts, texts = b.column(1), b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary())
        parts: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(b.column(0).to_pylist(), ref_texts.to_pylist(), strict=True)):
            parts.setdefault(key, []).append(k)
        keep = np.zeros(b.num_rows, bool)
        for (_, ref_text), rows in parts.items():
            keep[rows] = trie_links(shingle_set(ref_text, words), [shingle_set(texts[k].as_py(), words) for k in rows], ctx.value, percent)
        at = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays([ids.take(at), b.column(0).take(at)], names=["doc", "ref"])

    return map_arrow(attach_texts(pairs, docs), run, f"doc {types[0]}, ref {types[1]}")


def _may_link(n_a: Column, n_b: Column, shared: Column, percent: int) -> Column:
    """Whether two sets can be similar, by their sizes and the number of members that both first parts hold.

    Up to where the first of the two parts ends in the global order, all common members are among those shared; from
    there on that set has at most ceil(0.8 n) - 1 members left. Whichever ends first, the larger set's rest bounds it."""
    need = F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100.0 + percent) - 1e-9)
    rest = F.ceil(F.lit(percent) * F.greatest(n_a, n_b) / F.lit(100.0) - 1e-9) - 1
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (shared >= need - rest)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id of every row. Links inside a component that the first round made aren't listed."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    late = late_buckets(bucket_counts(base, words))
    sets = stage(signatures(base, late, words, percent), "sets")
    filled = sets.where("n > 0 and id is not null")
    classes = stage(filled.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    copies = stage(filled.select("id", "digest").join(classes.where("copies > 1"), "digest").select("id", "rep"), "copies").where("id <> rep")
    # rows of an id stay if one of its texts stands for a class
    gone = copies.join(classes.select(F.col("rep").alias("id")), "id", "left_anti").select("id").distinct()
    own = join_bounded(filled.select("id", "n", "sig"), stage(gone, "gone"), ["id"], "left_anti")
    members = own.select("id", F.explode("sig").alias("h"))
    shared = stage(members.groupBy("h").agg(F.min("id").alias("ref"), F.max("id").alias("last")).where("ref < last").select("h", "ref"), "shared")
    posts = stage(members.join(shared, "h").select("h", F.col("id").alias("doc"), "ref"), "posts")
    sizes = filled.select("id", "n")
    stars = posts.where("doc <> ref").groupBy("doc", "ref").agg(F.count(F.lit(1)).alias("c"))
    stars = stars.join(sizes.select(F.col("id").alias("doc"), F.col("n").alias("n_doc")), "doc").join(sizes.select(F.col("id").alias("ref"), F.col("n").alias("n_ref")), "ref")
    first = stage(stars.where(_may_link(F.col("n_doc"), F.col("n_ref"), F.col("c"), percent)).select("doc", "ref").distinct(), "first")
    links = stage(similar_pairs(first, base.where("id is not null"), late, words, percent), "links")
    labels = components(links, "star")
    discard(shared)
    marked = posts.select("h", "doc").join(labels.withColumnRenamed("id", "doc"), "doc", "left").select("h", "doc", F.coalesce("component", "doc").alias("c"))
    marked = stage(marked, "marked")
    mixed = stage(marked.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h"), "mixed")
    left = stage(marked.join(mixed, "h").join(sizes.withColumnRenamed("id", "doc"), "doc").select("h", "doc", "c", "n"), "left")
    # components differ, so all members that both first parts share are still here and count
    pairs = left.alias("a").join(left.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.c") < F.col("b.c")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")))
    pairs = pairs.select(F.greatest("a.doc", "b.doc").alias("doc"), F.least("a.doc", "b.doc").alias("ref"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    pairs = pairs.groupBy("doc", "ref").agg(F.count(F.lit(1)).alias("c"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"), F.max("n_a").alias("m_a"), F.max("n_b").alias("m_b"))
    repeated = (F.col("n_a") != F.col("m_a")) | (F.col("n_b") != F.col("m_b"))  # ids with several texts are all tried
    pairs = pairs.where(repeated | _may_link(F.col("n_a"), F.col("n_b"), F.col("c"), percent)).select("doc", "ref")
    discard(posts)
    second = stage(pairs.join(first, ["doc", "ref"], "left_anti"), "second")
    more = stage(similar_pairs(second, base.where("id is not null"), late, words, percent), "more")
    # every row of a class is linked to its representative
    all_links = links.unionByName(more).unionByName(copies.select(F.col("id").alias("doc"), F.col("rep").alias("ref")))
    final = stage(components(all_links, "all"), "final")
    discard(marked, mixed, left, first, second, links, more, classes)
    return sets.select("id", "n").join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
