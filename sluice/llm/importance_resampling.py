"""Operator 11: importance resampling towards a target distribution, features hashed by a streaming CRC ring.

A document's features are its runs of 1 to n consecutive words. One scan keeps a ring of running CRC-32 states, one for
each of the last n starts: a word extends every state by a space and itself and opens a new one, so no feature is ever
joined as text. The scan emits each feature's bucket; buckets are counted over the whole corpus and over the target texts;
a bucket's gain is the log ratio of its smoothed shares; a document's weight is the mean gain of its features. Gumbel
noise of the document's id turns the highest scores into a draw without replacement.

The scan's buckets are written once, two bytes a feature, and read again for the counts and for the weights. Counts,
gains and noise are sums and expressions of Spark; only the gains, one number a bucket, pass through the driver. Ranks
are running sums over range partitions, so no task holds all documents.

Defined results: null, empty and wordless texts have no features and weight 0; texts of any length are scanned in pieces
that carry the ring; a null id draws with the noise of an empty id and stands last among ties; rows of equal id are drawn
each on its own, though with equal noise; an empty corpus gives no rows, an empty target gains towards unseen buckets;
columns besides the two inputs are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import map_arrow, prefix_sum, stage

WORDS, BUCKETS = 2, 10_000
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: Documents of a range partition when ranks are given.
RANKED_ROWS = 200_000
#: A-Z become a-z; other bytes below 128 that are no letter or digit become spaces.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists, cut between words about every ``size`` bytes."""
    clean, at = text.translate(CLEAN), 0
    while at < len(clean):
        end = clean.find(b" ", at + size) + 1 or len(clean)
        yield clean[at:end].split()
        at = end


def feature_crcs(words: list[bytes], ring: list[int], n: int) -> tuple[list[int], list[int]]:
    """CRC-32 of every run of 1 to n words that ends in one of ``words``, and the ring after the last: its states belong to
    the runs that end there, shortest first."""
    crc32, out = zlib.crc32, []
    for w in words:
        longer = b" " + w
        ring = [crc32(w), *[crc32(longer, state) for state in ring[: n - 1]]]
        out += ring
    return out, ring


def _width(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def text_buckets(text: bytes | None, n: int = WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    ring, words, found = [], 0, []
    for piece in word_pieces(text or b""):
        crcs, ring = feature_crcs(piece, ring, n)
        words += len(piece)
        found.append((np.array(crcs, np.uint32) % buckets).astype(_width(buckets)))
    return words, np.concatenate(found) if found else np.empty(0, _width(buckets))


def hashed_features(docs: DataFrame, id_col: str, text_col: str, n: int, buckets: int, name: str) -> DataFrame:
    """id, n_words, and the features' buckets as fixed-width integers; a staged table."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(b):
        counted = [text_buckets(t, n, buckets) for t in b.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in counted], pa.int64()), pa.array([f.tobytes() for _, f in counted], pa.binary())], names=["id", "n_words", "buckets"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return stage(map_arrow(src, run, f"id {id_type}, n_words long, buckets binary"), name)


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: a task adds up its rows, Spark the tasks."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for f in b.column(0):
                total += np.bincount(np.frombuffer(f.as_buffer(), _width(buckets)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: 1000 times the log of the bucket's smoothed share of the target over that of the corpus, floored."""
    s, t = (bucket_counts(x, buckets).withColumnRenamed("n", name) for x, name in ((corpus, "s"), (target, "t")))
    rows = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    rows = stage(rows.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    whole = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    of = lambda c: F.col(c).cast("double")
    ratio = ((of("t") + 1) * (of("all_s") + buckets)) / ((of("s") + 1) * (of("all_t") + buckets))
    return rows.join(F.broadcast(whole), F.lit(True)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row


def weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight: the floored mean of the gains of a document's features."""
    id_type = features.schema["id"].dataType.simpleString()
    ctx = features.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(b):
        gain, n, weight = ctx.value, [], []
        for f in b.column(2):
            x = np.frombuffer(f.as_buffer(), _width(len(gain)))
            n.append(len(x))
            weight.append(int(gain[x].sum()) // len(x) if len(x) else 0)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return map_arrow(features, run, f"id {id_type}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw, floored, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row. ``percent`` of the rows of at least ``min_words`` words
    are drawn; ranks count from 1 by falling score, then id; undrawn rows have none."""
    corpus = hashed_features(docs, id_col, text_col, n, buckets, "features")
    goal = hashed_features(target.select(F.lit(0).alias("_sluice_id"), F.col(target_text).alias("_sluice_text")), "_sluice_id", "_sluice_text", n, buckets, "target-features")
    table = bucket_gains(corpus, goal, buckets).toPandas()  # one row a bucket
    gains = np.zeros(buckets, np.int64)
    gains[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    scored = weights(corpus, gains)
    scored = stage(scored.withColumn("score", F.col("weight") + gumbel("id", seed)), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    rows = able.count()
    order = able.select("*", (-F.col("score")).alias("_down"), F.col("id").isNull().alias("_none"), F.lit(1).cast("long").alias("_one"))
    ranked = prefix_sum(order, [], ["_down", "_none", "id", "n_features", "weight", "n_words"], "_one", "_before", max(1, -(-rows // RANKED_ROWS)), "ranks")
    rank = F.when(F.col("_before") < rows * percent // 100, F.col("_before") + 1)
    ranked = ranked.select("id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).withColumnRenamed("id", id_col)


def drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn rows of docs with weight and rank, for tables whose ids don't repeat. Null ids are matched with null ids."""
    picked = ranked.where("rank is not null").select(F.col(id_col).alias("_sluice_id"), "weight", "rank")
    columns = [docs[c] for c in docs.columns if c not in ("weight", "rank")]
    return docs.join(picked, docs[id_col].eqNullSafe(picked["_sluice_id"])).select(*columns, picked["weight"], picked["rank"])
