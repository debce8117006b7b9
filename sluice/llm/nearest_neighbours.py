"""Operator 9: nearest neighbours by score-aware anisotropic quantisation.

Squared distance is |q|^2 + |x|^2 - 2 q.x, so the search is for the largest q.x - |x|^2 / 2. Vectors are cut into pairs
of dimensions, each coded by one of 16 centroids (four bits). Codes and centroids minimise an error in which the part of
the residual parallel to the vector weighs ETA times the rest, for that part moves large inner products. A query's
inner products with the centroids form a table for every two codes (one byte); scans add table entries. The best
candidates of each block of vectors are reranked by exact distance in double precision, and the blocks' best are merged.

Centroids are fitted on a bounded sample (SAMPLE_ROWS, by a hash of the id); every vector is coded and scanned.

Defined results: vectors that are null, zero, hold null or non-finite components, or whose length differs from the most
common one take no part, as queries or candidates; repeated rows of one id and vector count once; an id with several vectors
is as near as its nearest one, as query and as candidate, and is listed once; rows with a query's own id aren't its
candidates; a query with fewer candidates gets all; ties go to the smaller id; an empty table gives no rows; other columns
are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._common import hash_sample, map_arrow, stage

SAMPLE_ROWS, CENTRES, SUB, THRESHOLD = 8_000, 16, 2, 0.2
#: Vectors and queries that meet in a task, and candidates of a block that are reranked before the bound is known.
BLOCK_ROWS, QUERY_ROWS, RERANK = 8_192, 2_048, 120


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual for inner products above ``threshold`` of the norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _padded(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), -x.shape[1] % (2 * SUB)), x.dtype)])


def encode(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (n, parts) that minimise |r|^2 + (ETA - 1) <r, x/|x|>^2, part by part in turns."""
    x = _padded(x.astype(np.float32))
    n, parts = len(x), books.shape[0]
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-20)
    xs, us = x.reshape(n, parts, SUB), (x / norm[:, None]).reshape(n, parts, SUB)
    extra = np.float32(eta(x.shape[1]) - 1)
    near = np.empty((n, parts, CENTRES), np.float32)  # |r_m|^2 by centre
    along = np.empty_like(near)  # <r_m, u_m> by centre
    for m in range(parts):
        r = xs[:, m, None, :] - books[m][None]
        near[:, m], along[:, m] = (r * r).sum(2), (r * us[:, m, None, :]).sum(2)
    codes = near.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2).sum((1, 2))
    for _ in range(sweeps):
        for m in range(parts):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (near[:, m] + extra * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def fit_codebooks(x: np.ndarray, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Centroids (parts, 16, 2): Lloyd's rounds for each part, then rounds of coding and least squares under the
    anisotropic error, which is quadratic in all centroids together."""
    x = _padded(x.astype(np.float32))
    n, dim = x.shape
    parts, rng = dim // SUB, np.random.default_rng(seed)
    books = np.empty((parts, CENTRES, SUB), np.float32)
    for m in range(parts):
        v = x[:, m * SUB : (m + 1) * SUB]
        c = v[rng.choice(n, CENTRES, replace=n < CENTRES)].copy()
        for _ in range(8):
            k = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
            count = np.bincount(k, minlength=CENTRES)
            for s in range(SUB):
                c[:, s] = np.where(count > 0, np.bincount(k, v[:, s], CENTRES) / np.maximum(count, 1), c[:, s])
        books[m] = c
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-20)
    extra, size = eta(dim) - 1, parts * CENTRES * SUB
    for _ in range(rounds):
        codes = encode(x, books).astype(np.int64)
        place = (np.arange(parts)[None] * CENTRES + codes)[:, :, None] * SUB + np.arange(SUB)
        place = place.reshape(n, dim)
        left, right = np.zeros((size, size)), np.zeros(size)
        for i in range(0, n, 1000):
            rows = place[i : i + 1000]
            d = np.zeros((len(rows), size), np.float32)
            np.put_along_axis(d, rows, u[i : i + 1000], 1)
            left += extra * (d.T @ d)
            right += np.bincount(rows.ravel(), ((1 + extra) * x[i : i + 1000]).ravel(), size)
        left[np.arange(size), np.arange(size)] += np.bincount(place.ravel(), minlength=size) + 1e-6
        right += 1e-6 * books.ravel()
        books = np.linalg.solve(left, right).reshape(books.shape).astype(np.float32)
    return books


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, parts / 2, 256): inner products by byte, which holds two codes."""
    qs = _padded(q.astype(np.float32)).reshape(len(q), -1, SUB)
    t = np.einsum("qms,mks->qmk", qs, books)
    return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def scan(packed: np.ndarray, table: np.ndarray, half_norm: np.ndarray) -> np.ndarray:
    """Approximate q.x - |x|^2 / 2 of a block; packed: (bytes, vectors)."""
    score = -half_norm
    for m in range(len(packed)):
        score = score + table[m][packed[m]]
    return score


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, rerank: int | None = None) -> list[tuple[int, int, float]]:
    """(query, id, distance) of each query's k best ids of a block; ids ascending. The best by code are measured; then all
    whose code's error lets them be nearer than the k-th of these."""
    rerank = rerank or RERANK
    packed = np.ascontiguousarray((codes[:, ::2].astype(np.uint8) << 4 | codes[:, 1::2]).T)
    half = (0.5 * (x * x).sum(1)).astype(np.float32)
    coded = books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
    off = np.linalg.norm(_padded(x) - coded, axis=1)
    # single precision of the scan's sums
    slack_q, slack = 1e-5 * float(np.linalg.norm(coded, axis=1).max()), 1e-5 * float(half.max())
    twice = len(ids) > 1 and bool((ids[1:] == ids[:-1]).any())
    out = []

    def nearest_ids(at, qid, qv):
        at = at[ids[at] != qid]
        d = np.sqrt(((x[at] - qv) ** 2).sum(1))
        order = np.lexsort((ids[at], d))
        at, d = at[order], d[order]
        if twice:
            first = np.sort(np.unique(ids[at], return_index=True)[1])
            at, d = at[first], d[first]
        return at[:k], d[:k]

    for start in range(0, len(q), 64):
        t = tables(q[start : start + 64], books)
        for a, (qid, qv) in enumerate(zip(q_ids[start : start + 64].tolist(), q[start : start + 64], strict=True)):
            s = scan(packed, t[a], half)
            at = np.arange(len(s))
            if len(s) > rerank:
                bar = np.partition(s, -rerank)[-rerank]
                over = np.flatnonzero(s > bar)
                some = np.concatenate([over, np.flatnonzero(s == bar)[: rerank - len(over)]])
                _, d = nearest_ids(some, qid, qv)
                norm = float(np.linalg.norm(qv))
                if len(d) == k:
                    at = np.flatnonzero(s + norm * (off + slack_q) + slack >= 0.5 * (norm * norm - float(d[-1]) ** 2))
            best, d = nearest_ids(at, qid, qv)
            out += [(qid, int(i), float(v)) for i, v in zip(ids[best], d, strict=True)]
    return out


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, id, score (distance) for the queries, rows whose id is divisible by ``every``, against all rows."""
    v = F.col("v")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    big = F.lit(float("inf"))
    src = src.where(F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < big), F.lit(False))) & F.exists(v, lambda e: e != 0)).withColumn("dim", F.size(v))
    dims = src.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = f"query_id long, rank int, {id_col} long, score double"
    spark = vectors.sparkSession
    if not dims:
        return spark.createDataFrame([], schema)
    src, n = src.where(F.col("dim") == dims[0]["dim"]).select("id", "v"), dims[0]["count"]
    sample = np.array([r.v for r in hash_sample(src, ["id"], sample_rows).orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).collect()])
    books = fit_codebooks(sample)
    src = src.dropDuplicates(["id", "v"])

    def code(b):
        x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in encode(x, books)], pa.binary())], names=["id", "v", "codes"])

    blocks = -(-n // BLOCK_ROWS)
    data = map_arrow(src, code, "id long, v array<double>, codes binary").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    data = stage(data, "coded")
    queries = data.where(F.col("id") % every == 0).select("id", "v")
    q_blocks = -(-max(1, queries.count()) // QUERY_ROWS)
    # a stated query set against all rows, in blocks: each block of vectors meets each block of queries
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("part", F.col("part").cast("long"))

    def of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        t = t.sort_by("id")
        return t.column("id").to_numpy(), np.array(t.column("v").to_pylist(), float).reshape(t.num_rows, -1), t

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            (q_ids, q, _), (ids, x, t) = of(a), of(b)
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            out = search_block(q_ids, q, ids, x, codes, books, k)
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    got = queries.groupBy("block", "part").cogroup(data.groupBy("block", "part")).applyInArrow(run, "query_id long, id long, score double")
    got = stage(got.groupBy("query_id", "id").agg(F.min("score").alias("score")), "neighbours")
    w = Window.partitionBy("query_id").orderBy("score", "id")  # k rows a block
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
