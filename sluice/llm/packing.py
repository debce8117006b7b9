"""Operator 2: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens, documents in hash order. A round adds a quantum of tokens, round x target
share, to every queue's deficit; the queue sends whole units of LEAST tokens of it, cutting documents, and what is left of
the deficit carries to the next round. A queue that runs dry leaves its share to the others, so that rounds stay as long as
windows. All this is arithmetic on a common clock: at time v a queue of weight w has been due w v tokens, the corpus
C(v) = sum of min(tokens, w v), and round r ends at C(v) = 2048 r. A unit is sent in the round in which its middle is due,
so deficits carry over windows and partitions exactly. Rounds follow each other in one long stream that is cut into windows;
rounding moves a round's edges by less than LEAST tokens a source and doesn't add up.

C is piecewise linear with a knot where queues run dry; queues that do so within about 1 % of each other share a knot, which
bounds the knots at some thousands for any number of sources. The place of a token in its queue is a running sum over range
partitions, as is the place of a round in the stream; a round's parts, about a window of tokens, are ordered together. No
source and no window order stands in one task.

The stream is cut every 2048 tokens wherever that falls; only the last window can be short. It is padded unless
its length is a power of two.

Defined results: a null or empty text is its end token alone; equal ids and repeated rows give their pieces each, at places
of their own, for the hash covers id and row; a null source is a queue of its own; sources without a given weight
get the smallest one; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._common import join_bounded, map_arrow, memo, prefix_sum, stage

WINDOW, END_ID = 2048, 1
#: Words in a worker's memo of token ids; when full it starts anew.
MEMO = 1_400_000
#: Text whose unknown words are encoded in one call.
LEARN_BYTES = 2 << 20
#: Rows of a range partition in the running sums.
ROWS_PER_PARTITION = 20_000
#: Tokens that a queue sends at least, but for its last ones.
LEAST = 8
_MARKS = b".,!?;:#%&$*"


class WordIds(dict):
    """Ids (little-endian uint32) of white-space-free words. The tokenizer drops white space and lower-cases, so a
    text's ids are its words' ids in order; marks after a letter or digit are pre-tokens of their own."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, words: list[bytes]) -> None:
        """Adds the ids of words. Words of letters alone are one pre-token each: they are encoded as one text and told apart
        by the tokens that end a pre-token; if these aren't as many as the words, and for all other words, one by one."""
        texts = [w.decode() for w in words]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in letters])], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) == len(letters) and ends[-1] == 4 * len(ids):
                raw, at = ids.tobytes(), 0
                for i, end in zip(letters, ends.tolist(), strict=True):
                    self[words[i]] = raw[at:end]
                    at = end
        rest = [i for i, w in enumerate(words) if w not in self]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            self[words[i]] = np.array(e.ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Adds the words that aren't known: lower-cased ones, or such as hold a special string, as they are written."""
        if len(self) + len(words) > MEMO:
            self.clear()
        whole, parted = set(), []
        for w in words:
            if w in self:
                continue
            core = w.rstrip(_MARKS)
            if len(core) == len(w) or not core or b"<|" in w or not (core[-1:].isalnum() if core[-1] < 128 else core.decode().lower()[-1].isalnum()):
                whole.add(w)
            else:
                marks = w[len(core) :]
                parted.append((w, core, marks))
                whole.add(core)
                whole.add(marks)
        self.encode([w for w in whole if w not in self])
        for w, core, marks in parted:
            self[w] = self[core] + self[marks]

    def texts(self, texts: list[bytes | None], end: bytes) -> list[bytes]:
        """Ids of whole texts, each with the end id."""
        out, held, size = [], [], 0
        for i, t in enumerate(texts):
            if not t:
                held.append([])
            else:
                held.append(t.lower().split() if b"<|" not in t else [w if b"<|" in w else w.lower() for w in t.split()])
            size += len(t or b"")
            if size > LEARN_BYTES or i + 1 == len(texts):
                self.learn(set().union(*held))
                out += [b"".join(map(self.__getitem__, w)) + end for w in held]
                held, size = [], 0
        return out


def tokenize(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_row, id, source, n (tokens with the end) and ids (little-endian uint32) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def run(b):
        ids = memo(("words", vocabulary), lambda: WordIds(vocabulary)).texts(b.column(3).cast(pa.binary()).to_pylist(), end)
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["_row", "id", "source", "n", "ids"])

    src = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(src, run, f"_row long, id {id_type}, source string, n long, ids binary")


def source_weights(sources: DataFrame, weights: tuple[int, ...], name: str = "source") -> DataFrame:
    """(q, w): weights repeated over the sources by code point, null last. sources: distinct names."""
    key = F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("q")
    k = F.row_number().over(Window.orderBy(F.col(name).asc_nulls_last())) - 1
    return sources.select(key, F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int")).alias("w"))


def queue_weights(rows: DataFrame, weights: dict[str | None, float] | tuple[int, ...] | None) -> DataFrame:
    """(q, tokens, w) of each queue."""
    per = rows.groupBy("q").agg(F.sum("n").alias("tokens"))
    if isinstance(weights, dict):
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit("" if k is None else f"={k}"), F.lit(float(v)))])
        return per.withColumn("w", F.coalesce(F.try_element_at(table, F.col("q")), F.lit(float(min(weights.values())))))
    if weights:
        names = per.select(F.when(F.col("q") != "", F.expr("substring(q, 2)")).alias("name"))
        return per.join(source_weights(names, weights, "name"), "q")
    return per.withColumn("w", F.col("tokens").cast("double"))


def clock(queues: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Knots (v, C(v)), ascending. queues: (q, tokens, w)."""
    dry = F.col("tokens") / F.col("w")
    rows = queues.groupBy(F.floor(F.log2(dry) * 64).alias("k")).agg(F.max(dry).alias("v"), F.sum("tokens").alias("t"), F.sum("w").alias("w")).orderBy("k").collect()
    v, t, w = (np.array([0.0, *(float(r[c]) for r in rows)]) for c in ("v", "t", "w"))
    return v, np.cumsum(t) + v * (w.sum() - np.cumsum(w))


def stream_places(rows: DataFrame, window: int = WINDOW, weights: dict[str | None, float] | tuple[int, ...] | None = None, least: int = LEAST, seed: int = 11) -> DataFrame:
    """rows: staged (_row, id, source, n). Parts of documents in the order sent: _row, source, from (the part's first token
    in its document), len, pos (its place in the packed stream).

    weights: target share by source, or numbers repeated over the sources by code point; without them each source's share
    of all tokens, so that all queues end together."""
    rows = rows.withColumn("q", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    queues = stage(queue_weights(rows, weights), "queues")
    v, c = clock(queues)
    parts = max(1, -(-rows.count() // ROWS_PER_PARTITION))
    place = F.xxhash64(F.lit(seed), F.col("id").cast("string"), "_row")
    queued = prefix_sum(rows.select("_row", "q", "n", place.alias("place")), ["q"], ["place", "_row"], "n", "before", parts, "places")
    queued = join_bounded(queued.select("_row", "q", "n", "before"), queues.select("q", "w"), ["q"]).select("_row", "q", "n", "before", "w")

    def cut(b):
        n, before, w = (b.column(i).to_numpy() for i in (2, 3, 4))
        first, last = before // least, (before + n - 1) // least
        many = last - first + 1
        row = np.repeat(np.arange(len(n)), many)
        unit = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        sent = np.ceil(np.interp((unit + 0.5) * least / w[row], v, c) / window).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(sent) != 0)])
        row, end = row[new], np.r_[new[1:], len(unit)] - 1
        begin, end = np.maximum(unit[new] * least, before[row]), np.minimum((unit[end] + 1) * least, (before + n)[row])
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *map(pa.array, (sent[new], begin, begin - before[row], end - begin))], names=["_row", "q", "round", "e", "from", "len"])

    sent = stage(map_arrow(queued, cut, "_row long, q string, round long, e long, from long, len long"), "parts")
    rounds = stage(sent.groupBy("round").agg(F.sum("len").alias("tokens")), "rounds")
    starts = prefix_sum(rounds, [], ["round"], "tokens", "start", max(1, -(-rounds.count() // ROWS_PER_PARTITION)), "stream").select("round", "start")
    # rows of about a window of tokens
    inside = Window.partitionBy("round").orderBy(F.xxhash64("round", "q"), "q", "e").rowsBetween(Window.unboundedPreceding, -1)
    placed = sent.withColumn("inside", F.coalesce(F.sum("len").over(inside), F.lit(0)))
    placed = join_bounded(placed, stage(starts, "starts"), ["round"])
    return placed.select("_row", F.when(F.col("q") != "", F.expr("substring(q, 2)")).alias("source"), "from", "len", (F.col("start") + F.col("inside")).alias("pos"))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, weights: dict[str | None, float] | tuple[int, ...] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids (binary)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    tokens = stage(tokenize(docs, vocabulary, id_col, text_col, source_col), "tokens")
    places = stream_places(tokens.select("_row", "id", "source", "n"), window, weights)
    # a document's parts, as many as its tokens at most
    places = places.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("from", "len", "pos"))).alias("parts"))
    placed = tokens.select("_row", "id", "n", "ids").join(places, "_row").select("id", "n", "ids", "parts.from", "parts.len", "parts.pos")

    def run(b):
        many = b.column(3).value_lengths().to_numpy()
        begin, left, pos = (b.column(i).flatten().to_numpy() for i in (3, 4, 5))
        # parts are cut where windows end
        first = pos // window
        pieces = (pos + left - 1) // window - first + 1
        at = np.repeat(np.arange(len(pos)), pieces)
        seq = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo, hi = np.maximum(pos[at], seq * window), np.minimum((pos + left)[at], (seq + 1) * window)
        start, row = begin[at] + lo - pos[at], np.repeat(np.arange(b.num_rows), many)[at]
        ids = b.column(2).cast(pa.large_binary())
        raw = memoryview(ids.buffers()[2])
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids)]
        here = offsets[row] + 4 * start
        spans = list(zip(here.tolist(), (here + 4 * (hi - lo)).tolist(), strict=True))
        crcs = np.fromiter((zlib.crc32(raw[x:y]) for x, y in spans), np.int64, len(spans))
        took = pa.array(row)
        cols = [b.column(0).take(took), pa.array(start), pa.array(hi - lo), pa.array(crcs), b.column(1).take(took), pa.array(seq), pa.array(lo - seq * window)]
        return pa.RecordBatch.from_arrays([*cols, *([pa.array([bytes(raw[x:y]) for x, y in spans], pa.binary())] if with_ids else [])], names=names)

    schema = f"{id_col} {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return map_arrow(placed, run, schema)


def padded_length(length: int, window: int = WINDOW) -> int:
    """What a sequence is padded to: the window, or its own length at a power of two."""
    return length if length & (length - 1) == 0 else window
