"""Operator 13: alignment of the tokens of two tokenizers, and how usual each aligned pair is in the corpus.

A text's tokens under both are runs of the same bytes. Offsets where tokens of both end cut the text into groups; tokens
of a group are linked with each other. A pair's count is the number of documents that link it.

Every document gives the multiplicities of its pairs. They are written as postings by the first side's id, blocks of a few
thousand documents, and dealt to tasks by that id: a task reads, in sorted order that Spark's sorter may spill, first the
counts of an id's pairs and then its postings, takes the maximum of the counts, and emits what the postings contribute to
their documents, at most one entry a posting, in blocks like theirs; tasks that are dealt these blocks sum them by document. Ids with many postings are dealt over several groups, each with the
id's counts, which are at most one for each id of the other side. Counts are summed by pair before, partially in each task,
so no pair and no id has to meet whole in one task.

Defined results: null and empty texts, and texts whose joined token bytes differ from a space and the text, have zeros and
an empty digest; rows of equal or null id are documents of their own; groups of many tokens give their pairs by distinct
ids, so a text without common cuts stays small; an empty table gives no rows; columns besides the two inputs are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import memo, stage

#: Documents of a block at most, and links that a task gathers before it writes blocks.
SLOTS, BLOCK_LINKS = 1 << 16, 1 << 21
#: Postings of one group of an id, and contributions that a task adds up before it emits them.
GROUP_POSTINGS, HELD = 1 << 21, 1 << 21
#: Groups of more links than this give them by distinct ids.
LARGE_GROUP = 4096
_EMIT_ROWS = 50_000
#: Fixed value: how a byte-level vocabulary splits text before its merges.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: First code point that isn't Latin.
PLAIN = chr(0x250)
_NAMES = ("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "base", "n", "slots", "bs", "ms")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows 255
    in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, each id's bytes, and each id as it is written in the digest of groups."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        self.ranked = None
        chars = byte_characters()
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        entry = lambda t: bytes(map(chars.__getitem__, t)) if all(c in chars for c in t) else t.encode()
        self.bytes_a = [entry(vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        written = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        # an id's separator: A first of its group, A later, B first, B later
        self.written = [sep + w for sep in (b";", b",", b"|", b",") for w in written]
        self.width = len(written)
        self.ranked = self._ranked()

    def _ranked(self):
        """The same vocabulary as ranks, whose library is several times faster, where the file is a byte-level one whose ids
        follow its merges; else None."""
        import tiktoken

        made = json.loads(self.a.to_str())
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        vocabulary, split = made["model"]["vocab"], made.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        places = [vocabulary.get("".join(m), -1) for m in merges]
        special = {t["id"] for t in made["added_tokens"]}
        if not plain or places != sorted(set(places)) or len(self.bytes_a) - len(special) != 256 + len(merges) or made["model"].get("dropout"):
            return None
        ranks = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of the first side. Texts of code points below PLAIN, whose classes all libraries share, go by ranks."""
        plain = [self.ranked is not None and (t.isascii() or max(t) < PLAIN) for t in texts]
        rest = iter(self.a.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.ranked.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for each text; None where the bytes don't agree."""
        out = []
        for t, ids_a, ids_b in zip(texts, self.ids_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + t.encode()
            same = b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw
            out.append((np.array(ids_a, np.int64), np.array(ids_b, np.int64)) if same else None)
        return out


def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return memo(("cross", byte_level, pieces), lambda: Tokenizers(byte_level, pieces))


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common ends, and the number of its group for each token of both sides, from the tokens' rising end offsets."""
    ends = np.zeros(int(max(ends_a.max(initial=0), ends_b.max(initial=0))) + 1, np.uint8)
    ends[ends_a] = 1
    ends[ends_b] |= 2
    cut_a, cut_b = ends[ends_a] == 3, ends[ends_b] == 3
    return ends_a[cut_a], np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b


def linked_pairs(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, a id, b id, multiplicity of links; tokens stand in the order of groups. Pairs may stand in several rows."""
    k = int(max(group_a.max(initial=-1), group_b.max(initial=-1))) + 1
    n_a, n_b = np.bincount(group_a, minlength=k), np.bincount(group_b, minlength=k)
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = n_a * n_b > LARGE_GROUP
    few = np.where(large, 0, n_b)[group_a]  # partners of each A token in small groups
    inner = np.arange(int(few.sum())) - np.repeat(np.cumsum(few) - few, few)
    out = [(np.repeat(group_a, few), np.repeat(a, few), b[np.repeat(at_b[group_a], few) + inner], np.ones(int(few.sum()), np.int64))]
    for g in np.flatnonzero(large):
        x, n_x = np.unique(a[at_a[g] : at_a[g] + n_a[g]], return_counts=True)
        y, n_y = np.unique(b[at_b[g] : at_b[g] + n_b[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), np.repeat(x, len(y)), np.tile(y, len(x)), (n_x[:, None] * n_y[None, :]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def written_groups(tok: Tokenizers, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids of both sides by group."""
    first = lambda g: np.concatenate([[True], g[1:] != g[:-1]])
    place = np.concatenate([2 * group_a, 2 * group_b + 1])
    word = np.concatenate([np.where(first(group_a), a, tok.width + a), np.where(first(group_b), 2 * tok.width + b, 3 * tok.width + b)])
    return b"".join(map(tok.written.__getitem__, word[np.argsort(place, kind="stable")].tolist()))[1:]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, rising, and the sums of each array of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value for each run that begins at ``starts``."""
    offsets = np.append(starts, len(values)).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, and where each row begins and ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    raw = column.buffers()[2]
    values = np.frombuffer(raw, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return values.view(dtype) if values.ctypes.data % np.dtype(dtype).itemsize == 0 else values.copy().view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def alignments(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A staged table of two kinds of rows: documents (row, id, n_a, n_b, n_groups, n_links, groups_sha256), and blocks of
    postings (a, base, n, slots, bs, ms): document base + slot links a with b, m times."""
    id_type = docs.schema[id_col].dataType.simpleString()

    wide = _side(pieces)

    def run(batches):
        from pyspark import TaskContext

        tok, types = tokenizers(byte_level, pieces), []
        side = len(tok.bytes_b)
        block, slot, keys, held = TaskContext.get().partitionId() << 24, 0, [], 0

        def rows(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in zip(_NAMES, types, strict=True)], names=list(_NAMES))

        def flush():
            nonlocal block, slot, keys, held
            if keys:
                key, m = _summed(*(np.concatenate(x) for x in zip(*keys, strict=True)))
                a, rest = np.divmod(key, SLOTS * side)
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                ends = np.append(starts[1:], len(a))
                for lo in range(0, len(starts), 2_000):
                    s = starts[lo : lo + 2_000]
                    cut = slice(int(s[0]), int(ends[min(lo + 2_000, len(starts)) - 1]))
                    part = {"a": pa.array(a[s], pa.int32()), "base": pa.array(np.full(len(s), block * SLOTS), pa.int64()), "n": pa.array((ends - starts)[lo : lo + 2_000], pa.int64())}
                    part |= {"slots": _binary((rest[cut] // side).astype(np.uint16), s - s[0]), "bs": _binary((rest[cut] % side).astype(wide), s - s[0]), "ms": _binary(m[cut].astype(np.uint32), s - s[0])}
                    yield rows(part)
            block, slot, keys, held = block + 1, 0, [], 0

        for batch in batches:
            if not types:
                types.extend([pa.int64(), batch.column(0).type, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3])
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if slot + part.num_rows > SLOTS or held >= BLOCK_LINKS:
                    yield from flush()
                texts = part.column(1).to_pylist()
                own = [k for k, t in enumerate(texts) if t]
                found = [(k, x) for k, x in zip(own, tok.encode([texts[k] for k in own]), strict=True) if x]
                counts, digests = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
                if found:
                    # the documents' bytes stand one after the other, so their ends are cuts like others
                    a, b = (np.concatenate([x[i] for _, x in found]) for i in (0, 1))
                    cuts, group_a, group_b = groups(np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b]))
                    at_a, at_b = 0, 0
                    first_groups = []
                    for k, (x, y) in found:
                        to_a, to_b = at_a + len(x), at_b + len(y)
                        lo, hi = int(group_a[at_a]), int(group_a[to_a - 1])
                        first_groups.append(lo)
                        digests[k] = hashlib.sha256(written_groups(tok, x, group_a[at_a:to_a], y, group_b[at_b:to_b])).hexdigest()
                        counts[:3, k] = len(x), len(y), hi - lo + 1
                        at_a, at_b = to_a, to_b
                    group, pair_a, pair_b, m = linked_pairs(a, group_a, b, group_b)
                    doc = np.array([k for k, _ in found])[np.searchsorted(first_groups, group, "right") - 1]
                    np.add.at(counts[3], doc, m)
                    keys.append(_summed((pair_a * SLOTS + slot + doc) * side + pair_b, m))
                    held += len(keys[-1][0])
                base = block * SLOTS + slot
                yield rows({"row": pa.array(np.arange(base, base + len(texts))), "id": part.column(0), **{c: pa.array(v) for c, v in zip(_NAMES[2:6], counts, strict=True)}, "groups_sha256": pa.array(digests)})
                slot += len(texts)
        if types:
            yield from flush()

    schema = f"row long, id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, base long, n long, slots binary, bs binary, ms binary"
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return stage(src.mapInArrow(run, schema), "alignments")


def pair_counts(postings: DataFrame, pieces: str) -> DataFrame:
    """a, b, n: documents that link the pair; each task adds up what it reads before Spark adds up tasks."""

    side = _side(pieces)

    def run(batches):
        keys, held = [], 0

        def emit():
            key, n = _summed(*(np.concatenate(x) for x in zip(*keys, strict=True)))
            for lo in range(0, len(key), _EMIT_ROWS):
                k = key[lo : lo + _EMIT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(k >> 32, pa.int32()), pa.array(k & 0xFFFFFFFF, pa.int32()), pa.array(n[lo : lo + _EMIT_ROWS])], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).to_numpy()
            bs, _ = _values(batch.column(2), side)
            key = (np.repeat(batch.column(0).to_numpy().astype(np.int64), sizes) << 32) | bs
            keys.append(_summed(key, np.ones(len(key), np.int64)))
            held += len(keys[-1][0])
            if held > HELD:
                yield from emit()
                keys, held = [], 0
        if keys:
            yield from emit()

    return postings.select("a", "n", "bs").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _side(pieces: str) -> type:
    """How wide the ids of the second side are written."""
    import sentencepiece

    return np.uint16 if sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size() <= 1 << 16 else np.uint32


def contributions(postings: DataFrame, counts: DataFrame, pieces: str, group_postings: int = GROUP_POSTINGS) -> DataFrame:
    """row, n_best, count_sum: sums by document, of each task's blocks of partial sums. counts: staged."""
    by_a = stage(counts.groupBy("a").agg(F.collect_list("b").alias("pair_b"), F.collect_list("n").alias("pair_n"), F.ceil(F.sum("n") / group_postings).cast("int").alias("parts")), "pairs-by-id")
    heads = by_a.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "pair_b", "pair_n")
    many = by_a.where("parts > 1").select("a", "parts")
    # at most one row for each id of the first side's vocabulary
    dealt = postings.join(F.broadcast(many), "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("base"), F.col("parts")), F.lit(0)).cast("int").alias("part"), F.lit(1).alias("kind"), "base", "n", "slots", "bs", "ms")
    both = heads.unionByName(dealt, allowMissingColumns=True).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    both = both.select("a", "part", "kind", "pair_b", "pair_n", "base", "n", "slots", "bs", "ms")

    side = _side(pieces)

    def run(batches):
        of, most, held, n_held = None, 0, [], 0

        def emit():
            row, best, total = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            block = row // SLOTS
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for lo in range(0, len(starts), 50):
                s = starts[lo : lo + 50]
                cut = slice(int(s[0]), int(starts[lo + 50]) if lo + 50 < len(starts) else len(row))
                columns = [_binary(x[cut], s - s[0]) for x in ((row % SLOTS).astype(np.uint16), best, total)]
                yield pa.RecordBatch.from_arrays([pa.array(block[s] * SLOTS), *columns], names=["base", "slots", "n_best", "count_sum"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, bases, sizes = (pc.fill_null(batch.column(k), 0).to_numpy() for k in (2, 5, 6))
            slots, at = _values(batch.column(7), np.uint16)
            bs, ms = _values(batch.column(8), side)[0], _values(batch.column(9), np.uint32)[0]
            heads_at = np.flatnonzero(kind == 0)
            # runs of posting rows between heads; a run at the batch's begin goes on with the id before
            for begin, end in zip([0, *(heads_at + 1)], [*heads_at, batch.num_rows], strict=True):
                if begin and kind[begin - 1] == 0:
                    pair_b, pair_n = (batch.column(k)[int(begin - 1)].values.to_numpy(zero_copy_only=False) for k in (3, 4))
                    of = np.zeros(int(pair_b.max()) + 1, np.int64)
                    of[pair_b] = pair_n
                    most = int(pair_n.max())
                if begin == end:
                    continue
                lo, hi = int(at[begin]), int(at[end])
                n, m = of[bs[lo:hi]], ms[lo:hi].astype(np.int64)
                row = np.repeat(bases[begin:end], sizes[begin:end]) + slots[lo:hi]
                held.append((row, m * (n == most), m * n))
                n_held += hi - lo
            if n_held > HELD:
                yield from emit()
                held, n_held = [], 0
        if held:
            yield from emit()

    blocks = both.mapInArrow(run, "base long, slots binary, n_best binary, count_sum binary")

    def add(batches):
        at, sums = None, np.zeros((2, SLOTS), np.int64)

        def emit():
            used = np.flatnonzero(sums[1])
            return pa.RecordBatch.from_arrays([pa.array(at + used), *(pa.array(x[used]) for x in sums)], names=["row", "n_best", "count_sum"])

        for batch in batches:
            slots, ends = _values(batch.column(1), np.uint16)
            best, total = (_values(batch.column(k), np.int64)[0] for k in (2, 3))
            for k, base in enumerate(batch.column(0).to_pylist()):
                if base != at:
                    if at is not None:
                        yield emit()
                    at = base
                    sums[:] = 0
                cut = slice(int(ends[k]), int(ends[k + 1]))
                sums[0, slots[cut]] += best[cut]  # a row's slots differ
                sums[1, slots[cut]] += total[cut]
        if at is not None:
            yield emit()

    return blocks.repartition("base").sortWithinPartitions("base").mapInArrow(add, "row long, n_best long, count_sum long")


def cross_align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", group_postings: int = GROUP_POSTINGS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    both = alignments(docs, byte_level, pieces, id_col, text_col)
    postings = both.where("a is not null").select("a", "base", "n", "slots", "bs", "ms")
    counts = stage(pair_counts(postings, pieces), "pair-counts")
    sums = contributions(postings, counts, pieces, group_postings)
    rows = both.where("a is null").select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def aligned_pairs(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n_docs, best: every pair that a document links, for a map of one vocabulary onto the other."""
    both = alignments(docs, byte_level, pieces, id_col, text_col)
    counts = stage(pair_counts(both.where("a is not null").select("a", "n", "bs"), pieces), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", F.col("n").alias("n_docs"), (F.col("n") == F.col("_most")).alias("best"))  # one row an id
