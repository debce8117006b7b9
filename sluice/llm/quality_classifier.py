"""Operator 7: document quality by co-training two views.

The text view sees the shapes of a text's words (letters, digits, marks, case; never the words themselves) and their
shares. The metadata view sees language, source and length. Each view's logistic model is fitted on labelled rows; over
rounds each view labels, of all unlabelled documents, those it is surest of for the other, in the labels' own proportion, and
both are refitted. Views are then calibrated (Platt scaling) and their calibrated log-odds combined by a last logistic model,
both on labelled rows that no fit has seen. Every document is scored over its whole text.

Labelled rows are a bounded sample (TRAIN_ROWS, by a hash of the id; CALIBRATION of them for calibration alone). Unlabelled
rows have no bound and stay on the cluster: each round's thresholds are percentiles over all of them, and the fit sees their
gradients, summed by Spark, STEPS times a round: the driver minimises the labelled rows' loss with a linear term that makes
its gradient that of the whole loss. All pseudo-labelled rows together weigh PSEUDO.

Defined results: null and empty texts have no shapes and get the text view's score of no evidence; unseen or null
languages and sources carry no metadata weight; without labels of both classes every score is 1.0 (nothing is known
against a document); an id with several labels has the largest, one with several texts is learned from one of them; repeated
rows each give a row; null ids are scored and never learned from; other columns are no inputs.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm._common import discard, hash_sample, join_bounded, map_arrow, memo, stage

TRAIN_ROWS, CALIBRATION, ROUNDS, STEPS, SHAPES, METAS = 5_000, 0.3, 3, 2, 512, 256
#: Share of the unlabelled documents that a view labels in a round, and what they weigh together against all labelled rows.
SURE, PSEUDO = 0.1, 0.1
MEMO = 400_000
_RUNS = re.compile(r"(.)\1+")


def word_shape(word: bytes) -> int:
    """Bucket of a word's shape: letters a or A, digits 0, other marks themselves, runs of the same kind once."""
    text = word.decode(errors="replace")
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text)
    return zlib.crc32(_RUNS.sub(r"\1", kinds).encode()) % SHAPES


class Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        s = self[word] = word_shape(word)
        return s

    def vector(self, text: bytes | None) -> np.ndarray:
        """Square roots of the shapes' shares of the words, and the share of repeated words."""
        words = text.split() if text else []
        x = np.zeros(SHAPES + 1, np.float32)
        if words:
            x[:SHAPES] = np.sqrt(np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), minlength=SHAPES) / len(words))
            x[SHAPES] = 1 - len(set(words)) / len(words)
        return x


def meta_vector(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(METAS, np.float32)
    for name, value in (("lang", lang), ("source", source)):
        if value is not None:
            x[zlib.crc32(f"{name}={value}".encode()) % (METAS - 16)] = 1
    if n_chars is not None and n_chars >= 0:
        x[METAS - 16 + min(15, int(n_chars).bit_length() // 2)] = 1
    return x


def _gradient(x1: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x1.T @ (1 / (1 + np.exp(-np.clip(x1 @ w, -35, 35))) - y) / len(y)


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, tilt: np.ndarray | None = None, l2: float = 1e-5, steps: int = 120) -> np.ndarray:
    """Weights with the bias last, by accelerated gradient steps on the mean logistic loss and, if given, tilt . w."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = v = np.zeros(x1.shape[1]) if start is None else start
    step = 4.0 / max(1e-9, float((x1.astype(float) ** 2).sum() / len(x1)))
    for k in range(steps):
        g = _gradient(x1, y, v)
        g[:-1] += l2 * v[:-1]
        if tilt is not None:
            g = g + tilt
        new = v - step * g
        v, w = new + k / (k + 3) * (new - w), new
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    platt: tuple[np.ndarray, np.ndarray]
    both: np.ndarray

    def views(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = _margin(_margin(xt, self.text)[:, None], self.platt[0])
        b = _margin(_margin(xm, self.meta)[:, None], self.platt[1])
        z = _margin(np.stack([a, b], 1), self.both)
        return tuple(1 / (1 + np.exp(-np.clip(s, -35, 35))) for s in (a, b, z))


def calibrated(wt: np.ndarray, wm: np.ndarray, xt: np.ndarray, xm: np.ndarray, y: np.ndarray) -> CoTrained:
    """Platt scaling of both views and their combination, on rows that the views weren't fitted on."""
    platt = tuple(_logistic(_margin(x, w)[:, None], y) for x, w in ((xt, wt), (xm, wm)))
    both = _logistic(np.stack([_margin(_margin(x, w)[:, None], p) for x, w, p in zip((xt, xm), (wt, wm), platt, strict=True)], 1), y)
    return CoTrained(wt, wm, platt, both)


class Pool:
    """All unlabelled documents' features, a staged table, and sums over it."""

    def __init__(self, rows: DataFrame):
        self.rows, self.spark = rows, rows.sparkSession

    def thresholds(self, w: tuple[np.ndarray, np.ndarray], low: float, high: float) -> list[tuple[float, float]]:
        """Of each view the margins below and above which its surest shares lie."""

        def run(b):
            t, m = margins(b, w)
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(m)], names=["t", "m"])

        got = map_arrow(self.rows, run, "t double, m double").agg(*[F.percentile_approx(c, [low, 1 - high], 10_000) for c in "tm"]).first()
        return [tuple(x) if x else (-np.inf, np.inf) for x in got]

    def gradients(self, chosen_by: tuple[np.ndarray, np.ndarray], cuts: list[tuple[float, float]], w: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray | None]:
        """Mean gradient of each view's loss over the documents that the other view is sure of; None if there are none."""
        sizes = [len(x) + 1 for x in w]  # weights, bias and the count

        def run(batches):
            sums = [np.zeros(n) for n in sizes]
            for b in batches:
                if not b.num_rows:
                    continue
                parts, judges, now = sparse(b), margins(b, chosen_by), margins(b, w)
                for i in (0, 1):
                    other, (lo, hi) = judges[1 - i], cuts[1 - i]
                    y = np.where((other <= lo) & (other < 0), 0.0, np.where((other >= hi) & (other > 0), 1.0, np.nan))
                    sure = ~np.isnan(y)
                    err = np.where(sure, 1 / (1 + np.exp(-np.clip(now[i], -35, 35))) - y, 0.0)
                    row, at, value = parts[i]
                    sums[i][: len(w[i]) - 1] += np.bincount(at, value * err[row], len(w[i]) - 1)
                    sums[i][-2] += err.sum()
                    sums[i][-1] += sure.sum()
            flat = np.concatenate(sums)
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(flat[used])], names=["k", "v"])

        flat = np.zeros(sum(sizes))
        for r in self.rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row a weight
            flat[r.k] = r.v
        halves = flat[: sizes[0]], flat[sizes[0] :]
        return [h[:-1] / h[-1] if h[-1] else None for h in halves]


def sparse(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, value) of both views from columns ti, tv, mi."""
    out = []
    for at, values in (("ti", "tv"), ("mi", None)):
        lists = [np.frombuffer(x, "<u2") for x in b.column(b.schema.get_field_index(at)).to_pylist()]
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        feature = np.concatenate(lists).astype(np.int64)
        value = np.frombuffer(b"".join(b.column(b.schema.get_field_index(values)).to_pylist()), "<f4").astype(float) if values else np.ones(len(row))
        out.append((row, feature, value))
    return out


def margins(b: pa.RecordBatch, w: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(row, value * x[at], b.num_rows) + x[-1] for (row, at, value), x in zip(sparse(b), w, strict=True)]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool: Pool | None, rounds: int = ROUNDS, steps: int = STEPS, share: float = SURE, pseudo: float = PSEUDO) -> tuple[np.ndarray, np.ndarray]:
    """Both views' weights. y: 0 or 1 of labelled rows."""
    views = [np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (xt, xm)]
    w = [_logistic(x, y) for x in (xt, xm)]
    for _ in range(rounds if pool else 0):
        judges = tuple(w)
        cuts = pool.thresholds(judges, share * float(1 - y.mean()), share * float(y.mean()))
        for _ in range(steps):
            for i, g in enumerate(pool.gradients(judges, cuts, tuple(w))):
                if g is not None:
                    # (1 - pseudo) labelled loss + pseudo the others', near the present weights, over (1 - pseudo)
                    w[i] = _logistic((xt, xm)[i], y, w[i], pseudo * (g - _gradient(views[i], y, w[i])))
    return w[0], w[1]


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch whose first columns are text, lang, source, n_chars."""
    shapes = memo("shapes", Shapes)
    xt = np.stack([shapes.vector(t) for t in b.column(0).cast(pa.binary()).to_pylist()])
    xm = np.stack([meta_vector(*m) for m in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)])
    return xt, xm


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS, held_out_mod: int = 5, rounds: int = ROUNDS) -> CoTrained | None:
    """Fits on at most ``rows`` labelled documents and all unlabelled ones, both outside the held-out fold."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % held_out_mod != 0
    known = stage(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y is not null and id is not null").groupBy("id").agg(F.max("y").alias("y")), "labels")
    mine = hash_sample(known.where(fold), ["id"], rows).orderBy(F.xxhash64("id"), "id").limit(rows)
    base = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.col(id_col).alias("id"))

    def run(b):
        xt, xm = _features(b)
        at = [np.flatnonzero(x) for x in xt]
        cols = [pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([x[i].astype("<f4").tobytes() for x, i in zip(xt, at, strict=True)], pa.binary()), pa.array([np.flatnonzero(x).astype("<u2").tobytes() for x in xm], pa.binary())]
        return pa.RecordBatch.from_arrays([b.column(4), *cols], names=["id", "ti", "tv", "mi"])

    made = stage(map_arrow(base.where(fold & F.col("id").isNotNull()), run, f"id {docs.schema[id_col].dataType.simpleString()}, ti binary, tv binary, mi binary"), "features")
    got = made.join(F.broadcast(mine), "id").groupBy("id").agg(F.min(F.struct("ti", "tv", "mi")).alias("x"), F.max("y").alias("y")).select("x.*", "y").toArrow()
    data = sorted(zip(*(got.column(c).to_pylist() for c in ("ti", "tv", "mi", "y")), strict=True)) if got.num_rows else []
    y = np.array([float(d[3] > 0) for d in data])
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(7)
    order = rng.permutation(len(data))
    table = pa.record_batch([pa.array([data[i][c] for i in order], pa.binary()) for c in range(3)], names=["ti", "tv", "mi"])
    y = y[order]
    dense = []
    for (row, at, value), n in zip(sparse(table), (SHAPES + 1, METAS), strict=True):
        x = np.zeros((len(y), n), np.float32)
        x[row, at] = value
        dense.append(x)
    cut = int(len(y) * CALIBRATION)
    fit, last = slice(cut, None), slice(0, cut)
    if len(set(y[fit].tolist())) < 2 or len(set(y[last].tolist())) < 2:
        fit = last = slice(None)  # too few labels to part
    pool = stage(join_bounded(made, known.select("id"), ["id"], "left_anti").select("ti", "tv", "mi"), "pool")
    wt, wm = co_train(dense[0][fit], dense[1][fit], y[fit], None if pool.isEmpty() else Pool(pool), rounds)
    discard(made, pool)
    return calibrated(wt, wm, dense[0][last], dense[1][last], y[last])


def score_quality(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """id, text_score, meta_score, score, kept of every row."""
    base = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.col(id_col))
    if model is None:
        return base.select(id_col, *[F.lit(1.0).alias(c) for c in ("text_score", "meta_score", "score")], F.lit(True).alias("kept"))
    ctx = docs.sparkSession.sparkContext.broadcast(model)  # SHAPES + METAS weights
    schema = T.StructType([base.schema[id_col], *(T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")), T.StructField("kept", T.BooleanType())])

    def run(b):
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            s = ctx.value.views(*_features(part))
            yield pa.RecordBatch.from_arrays([part.column(4), *map(pa.array, s), pa.array(s[2] >= threshold)], names=schema.names)

    return map_arrow(base, run, schema)
