"""A Bloom filter over a table of 64-bit hashes, built by Spark and tested in the tasks.

Bits are set by a grouped OR over 64-bit words, so no task sees all hashes; the words that hold bits come to the driver as
one array of at most MAX_BITS and go to the tasks as a broadcast. A hash that the filter refuses isn't in the table, so it
needn't shuffle; what it accepts still has to be looked up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and bits in all: 128 MB. Larger tables get fewer bits a hash, and more hashes pass.
BITS_PER_HASH, MAX_BITS = 16, 1 << 30
#: Probes a hash, each from its own bits.
PROBES = (0, 21)


def filter_bits(rows: int) -> int:
    """Bits of a filter for so many hashes: a power of two."""
    return min(MAX_BITS, max(1 << 12, 1 << (BITS_PER_HASH * max(1, rows) - 1).bit_length()))


def build(hashes: DataFrame, rows: int) -> np.ndarray:
    """The filter's words. hashes: one column of longs; rows: how many there are, to size it."""
    bits, column = filter_bits(rows), F.col(hashes.columns[0])
    at = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) for s in PROBES]))
    words = hashes.select(at.alias("at")).select(F.shiftrightunsigned("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most MAX_BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def of_array(hashes: np.ndarray) -> np.ndarray:
    """The filter's words of an array of hashes."""
    out = np.zeros(filter_bits(len(hashes)) // 64, np.uint64)
    for s in PROBES:
        at = (hashes.view(np.uint64) >> np.uint64(s)) & np.uint64(len(out) * 64 - 1)
        np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def accepted(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Those of the hashes (unsigned) that may be in the table."""
    mask, low = np.uint64(len(words) * 64 - 1), np.uint64(63)
    for s in PROBES:
        at = (hashes >> np.uint64(s)) & mask
        hashes = hashes[(words[(at >> np.uint64(6)).astype(np.int64)] >> (at & low)) & np.uint64(1) == 1]
    return hashes
