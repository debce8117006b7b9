"""Operator 4: toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the words' first letters (inflected insults share their
stem); each is hashed to a bucket. Buckets that differ between labelled classes become features. The machine adds to
linear weights an inner product of two learned vectors for every pair of present terms, so that pairs, such as an
insult with the mention of a group, weigh more than their parts.

The model is fitted on a bounded sample of labelled documents (TRAIN_ROWS, in the order of a hash of the id) and has at most
MAX_FEATURES features, those whose classes differ most; every document is scored over its whole text. Labels, language, source
and id are never inputs of a score.

Defined results: null, empty and wordless texts get the score of a document without terms; rows without a label
are scored alike; an empty label table gives every document the score 0.0; an id with several labels has the largest, one
with several texts is learned from the first in code point order; repeated rows each give a row; null ids are scored.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm._common import discard, hash_sample, map_arrow, memo, stage

TRAIN_ROWS, BUCKETS, FACTORS, MAX_FEATURES = 20_000, 1 << 18, 8, 8192
PREFIXES = (4, 5, 6)
MEMO = 400_000
#: Marks cut off a word's ends.
_STRIP = b".,;:!?\"'()[]{}<>#%&$*|~_-"


def word_terms(word: bytes) -> tuple[int, ...]:
    w = word.lower().strip(_STRIP)
    if not w:
        return ()
    text = w.decode(errors="replace").lower()
    terms = {zlib.crc32(b"w" + text.encode()) % BUCKETS}
    terms.update(zlib.crc32(b"p" + text[:k].encode()) % BUCKETS for k in PREFIXES if len(text) >= k)
    return tuple(terms)


class Terms(dict):
    """Features of a word, kept: buckets, or with ``keep`` the indices of those that are features."""

    def __init__(self, keep: dict[int, int] | None = None):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        t = word_terms(word)
        self[word] = t = t if self.keep is None else tuple(self.keep[x] for x in t if x in self.keep)
        return t

    def of(self, text: bytes | None) -> list[int]:
        if not text:
            return []
        return sorted({x for t in map(self.__getitem__, set(text.split())) for x in t})


@dataclass
class FactorizationMachine:
    """bias + sum of w over present features + sum over their pairs of <v_i, v_j>, through the logistic function."""

    buckets: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        n = np.array([len(r) for r in rows])
        z = np.full(len(rows), self.bias)
        if n.sum():
            at = np.repeat(np.arange(len(rows)), n)
            ids = np.fromiter((x for r in rows for x in r), np.int64, int(n.sum()))
            z += np.bincount(at, self.w[ids], len(rows))
            for k in range(self.v.shape[1]):
                x = self.v[ids, k]
                z += 0.5 * (np.bincount(at, x, len(rows)) ** 2 - np.bincount(at, x * x, len(rows)))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def choose_features(dt: np.ndarray, dn: np.ndarray, nt: float, nn: float) -> np.ndarray:
    """Places of the buckets that become features, given the toxic and other texts that hold each: held by 3 texts or
    more, shares of the classes 3.5 standard errors apart or more; the largest differences first, MAX_FEATURES at most."""
    p = (dt + dn) / (nt + nn)
    z = np.abs(dt / nt - dn / nn) / np.sqrt(np.maximum(p * (1 - p) * (1 / nt + 1 / nn), 1e-12))
    z[(dt + dn < 3) | (z < 3.5)] = 0
    return np.sort(np.argsort(-z, kind="stable")[: min(MAX_FEATURES, int((z > 0).sum()))])


def fit_features(data: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, log_odds: np.ndarray, factors: int = FACTORS, epochs: int = 12, rate: float = 0.15, l2: float = 1e-4, seed: int = 5) -> FactorizationMachine:
    """data: each text's features. AdaGrad on logistic loss, from a part of the features' log-odds."""
    y = y.astype(float)
    bias = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    w = 0.3 * log_odds
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.02, (len(w), factors))
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // 64)):
            m = np.array([len(data[i]) for i in part])
            k, who = np.concatenate([data[i] for i in part]) if m.sum() else np.empty(0, np.int64), np.repeat(np.arange(len(part)), m)
            vs = v[k]
            total = np.zeros((len(part), factors))
            np.add.at(total, who, vs)
            square = np.zeros((len(part), factors))
            np.add.at(square, who, vs * vs)
            score = bias + np.bincount(who, w[k], len(part)) + 0.5 * (total**2 - square).sum(1)
            err = 1 / (1 + np.exp(-np.clip(score, -35, 35))) - y[part]
            g = float(err.mean())
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if not m.sum():
                continue
            used, inv = np.unique(k, return_inverse=True)
            dw = np.bincount(inv, err[who]) / len(part) + l2 * w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, inv, err[who, None] * (total[who] - vs) / len(part))
            dv += l2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return FactorizationMachine(buckets, bias, w, v)


def _log_odds(dt: np.ndarray, dn: np.ndarray, nt: float, nn: float) -> np.ndarray:
    return np.log((dt + 0.5) / (nt + 1)) - np.log((dn + 0.5) / (nn + 1))


def fit_machine(rows: list, labels: np.ndarray) -> FactorizationMachine:
    """The machine of texts given as lists of buckets."""
    nt, nn = max(1.0, labels.sum()), max(1.0, (1 - labels).sum())
    ids = np.concatenate([np.asarray(r, np.int64) for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    dt, dn = (np.bincount(ids, x[at], BUCKETS) for x in (labels, 1 - labels))
    chosen = choose_features(dt, dn, nt, nn)
    keep = np.full(BUCKETS, -1)
    keep[chosen] = np.arange(len(chosen))
    data = [keep[np.asarray(r, np.int64)] for r in rows]
    return fit_features([r[r >= 0] for r in data], labels, chosen, _log_odds(dt[chosen], dn[chosen], nt, nn))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, held_out_mod: int | None = 5) -> FactorizationMachine | None:
    """Fits on at most ``rows`` labelled documents, in the order of a hash of their ids. The texts' buckets stay in a
    scratch table; the driver sees counts of the buckets that differ and the sample's features alone."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out_mod:
        known = known.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out_mod != 0)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = hash_sample(known, ["id"], rows).orderBy(F.xxhash64("id"), "id").limit(rows)

    def buckets(b):
        terms = memo("buckets", Terms)
        return pa.RecordBatch.from_arrays([pa.array([terms.of(x) for x in b.column(0).cast(pa.binary()).to_pylist()], pa.list_(pa.int32())), b.column(1)], names=["t", "y"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")  # ``rows`` ids at most
    texts = texts.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y")).select("text", "y")
    sample = stage(map_arrow(texts, buckets, "t array<int>, y int"), "labelled")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    if not total.n:
        return None
    nt, nn = max(1.0, float(total.t)), max(1.0, float(total.n - total.t))
    stats = sample.select("y", F.explode("t").alias("b")).groupBy("b").agg(F.sum("y").alias("dt"), F.sum(1 - F.col("y")).alias("dn"))
    share = (F.col("dt") + F.col("dn")) / (nt + nn)
    apart = F.abs(F.col("dt") / nt - F.col("dn") / nn) >= 3.4 * F.sqrt(share * (1 - share) * (1 / nt + 1 / nn))
    stats = stats.where((F.col("dt") + F.col("dn") >= 3) & apart).orderBy("b").toPandas()
    dt, dn = stats["dt"].to_numpy(float), stats["dn"].to_numpy(float)
    at = choose_features(dt, dn, nt, nn)
    chosen = stats["b"].to_numpy(np.int64)[at]

    def features(b):
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
        place = np.searchsorted(chosen, flat)
        hit = np.zeros(len(flat), bool) if not len(chosen) else chosen[np.minimum(place, len(chosen) - 1)] == flat
        ends = np.cumsum([len(x) if x is not None else 0 for x in b.column(0).to_pylist()])
        rows = [p[h].astype("<i4").tobytes() for p, h in zip(np.split(place, ends[:-1]), np.split(hit, ends[:-1]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], names=["t", "y"])

    got = map_arrow(sample, features, "t binary, y int").toArrow()
    # in the order of contents, so that the fit doesn't depend on the order of arrival
    data = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    discard(sample)
    return fit_features([np.frombuffer(t, "<i4").astype(np.int64) for t, _ in data], np.array([y for _, y in data]), chosen, _log_odds(dt[at], dn[at], nt, nn))


def score_toxicity(docs: DataFrame, model: FactorizationMachine | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score and the columns ``keep`` of every row."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *keep)
    if model is None:
        return src.select(id_col, F.lit(0.0).alias("score"), *keep)
    ctx = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES features
    tag = uuid.uuid4().hex
    fields = [src.schema[id_col], *(src.schema[c] for c in keep)]
    schema = T.StructType([fields[0], T.StructField("score", T.DoubleType()), *fields[1:]])

    def run(b):
        m = ctx.value
        terms = memo(("features", tag), lambda: Terms({int(x): i for i, x in enumerate(m.buckets)}))
        s = m.scores([terms.of(t) for t in b.column(1).cast(pa.binary()).to_pylist()])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *b.columns[2:]], names=schema.names)

    return map_arrow(src, run, schema)
