"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

Every document of a source asks for the same real number of copies, target / source size. Its whole part is
taken; the fractions are rounded by the pivotal method: a document and a pool of the next smaller ones pass mass (words)
to each other, at odds that keep each one's expectation, until the document's fraction or one of the pool's is 0 or 1.
A pool, instead of one partner, has room for a large document's whole rest, so that large documents settle first and
the small ones take up what they leave. Buckets of a source do this on their own, largest documents first, and hand
their one open fraction up a tree of coarser buckets. A source has as many buckets as its own documents need; its total
differs from its target by less than the document that stays open to the end, one of its smallest where the small ones
together outweigh the large. Buckets and draws come from hashes of the row's contents, not from the cluster's layout.

Defined results: a null or wordless text has size 0 and takes 0; a null source sorts last and is a source of
its own; a source without words has target 0; null ids are documents; rows of equal id, source and size are told apart by
their place in the table, so that only which of them is taken depends on it; repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import join_bounded, prefix_sum, stage

WEIGHTS, SHARE, MAX_COPIES = (3, 1, 2), 1.5, 2
#: Documents of a bucket, and buckets that meet in one of the next level.
BUCKET_DOCS, FAN_IN = 2048, 64
#: Smaller documents that pass mass to one document together.
POOL = 64
#: Fractions this near to 0 or 1 count as whole.
WHOLE = 1e-9
#: Sources of a range partition in the running sums.
SOURCES_PER_PARTITION = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """From (source, size): source, source_size, target. Weights repeat over the sources by code point, null last;
    targets over cap x size stop there and the excess goes to the others by weight until none is above.

    Water filling in closed form: sources are capped in the order of cap x size / weight; the level of a source
    says whether it is still capped when all before it are."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    per = stage(per, "sources")
    parts = max(1, -(-per.count() // SOURCES_PER_PARTITION))
    ranked = prefix_sum(per.withColumn("one", F.lit(1).cast("long")), [], ["none", "source"], "one", "k", parts, "ranks")
    ranked = ranked.select("source", "none", "source_size", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("k") % len(weights) + 1).cast("int")).alias("w"))
    ranked = stage(ranked.withColumn("ratio", F.col("source_size") * cap / F.col("w")), "ratios")
    x = prefix_sum(ranked, [], ["ratio", "none", "source"], "source_size", "size_before", parts, "spent")
    if parts > 1:
        x = stage(x, "spent-sums")
    x = prefix_sum(x, [], ["ratio", "none", "source"], "w", "w_before", parts, "weights")
    whole = ranked.agg((F.sum("source_size") * share).alias("pool"), F.sum("w").alias("w_all"))
    # what each unit of weight would get if all sources of lower ratio are capped; capped while that is above the ratio
    level = (F.col("pool") - F.col("size_before") * cap) / (F.col("w_all") - F.col("w_before"))
    x = x.join(F.broadcast(whole), F.lit(True)).withColumn("level", level)  # one row
    final = x.agg(F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))), F.lit(float("inf"))).alias("final"))
    return x.join(F.broadcast(final), F.lit(True)).select("source", "source_size", F.least(F.col("source_size") * cap, F.col("w") * F.col("final")).alias("target"))


def _round_bucket(rows: list[tuple], last: bool, pool: int = POOL) -> tuple[list[tuple], tuple | None]:
    """rows: (key, size, fraction, draw), largest first. Returns settled (key, extra copies) and the open row, if any.

    The first open row a meets the next ``pool`` ones: words move between a and them, each of fraction g taking a part
    in proportion to size * g * (1 - g), until a or one of them is at 0 or 1. a's fraction rises with probability (what
    the move down allows) / (both), so all expectations and the sum of words stay."""
    size, f = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    f[size <= 0] = 0.0
    rng = np.random.default_rng([int(r[3] * (1 << 52)) for r in (rows[0], rows[-1])] + [len(rows)])
    live = np.flatnonzero((f > WHOLE) & (f < 1 - WHOLE))
    while live.size > 1:
        head = live[: pool + 1]
        a, rest = head[0], head[1:]
        g = f[rest]
        share = g * (1 - g)
        room = float(size[rest] @ share)
        up = min((1 - f[a]) * size[a], room / (1 - g.min()))
        down = min(f[a] * size[a], room / g.max())
        move = up if rng.random() < down / (up + down) else -down
        f[a] += move / size[a]
        f[rest] = g - move / room * share
        open_ = (f[head] > WHOLE) & (f[head] < 1 - WHOLE)
        live = np.concatenate([head[open_], live[pool + 1 :]])
    left = None
    if live.size:
        k = int(live[0])
        if last:
            f[k] = float(rng.random() < f[k])
        else:
            left = (rows[k][0], rows[k][1], float(f[k]), rows[k][3])
    return [(r[0], int(x > 0.5)) for i, (r, x) in enumerate(zip(rows, f, strict=True)) if left is None or i != k], left


def pivotal_round(rows: DataFrame, fan_in: int = FAN_IN, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """rows, a staged table: key binary, grp string, size long, fraction double, draw double, mix long. Returns key, extra.

    A reduction tree for each ``grp``: level 0 has 2**bits buckets of about bucket_docs rows; each level joins fan_in of them."""
    per = rows.groupBy("grp").agg(F.expr(f"count(*) div {bucket_docs}").alias("_q"))
    per = stage(per.select("grp", F.when(F.col("_q") > 0, F.length(F.bin("_q"))).otherwise(0).alias("bits")), "buckets")
    deepest = per.agg(F.max("bits")).first()[0] or 0
    step = fan_in.bit_length() - 1
    names = ["key", "grp", "size", "fraction", "draw", "mix", "bits"]
    types = (pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32())

    def run(batches):
        """Rows of a bucket follow each other, also over batches; settled rows have an extra, open ones the other columns."""
        held, mixes, tag, out = [], {}, None, []

        def flush():
            done, left = _round_bucket(held, tag[2] == 0)
            out.extend((k, e, None, None, None, None, None, None) for k, e in done)
            if left is not None:
                out.append((left[0], None, tag[0], *left[1:], mixes[left[0]], tag[2]))

        def emit():
            cols = list(zip(*out, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "extra", *names[1:]])

        for b in batches:
            for key, grp, size, f, draw, mix, bits, bucket in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tag is not None and tag != (grp, bucket, bits):
                    flush()
                    held, mixes = [], {}
                    if len(out) > 5000:
                        yield emit()
                        out.clear()
                tag = (grp, bucket, bits)
                held.append((key, size, f, draw))
                mixes[key] = mix
        if held:
            flush()
        if out:
            yield emit()

    outs, open_rows = [], join_bounded(rows, per, ["grp"], "inner")
    for depth in range(0, deepest + step, step):
        src = open_rows.withColumn("bucket", F.expr("shiftrightunsigned(mix, 63 - bits)")).select(*names, "bucket")
        ordered = src.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", F.desc("size"), "mix", "key")
        res = stage(ordered.mapInArrow(run, "key binary, extra int, grp string, size long, fraction double, draw double, mix long, bits int"), "pivot")
        outs.append(res.where("extra is not null").select("key", "extra"))
        open_rows = res.where("extra is null").select(*names[:-1], F.greatest(F.col("bits") - step, F.lit(0)).alias("bits"))
        if depth >= deepest:
            break
    out = outs[0]
    for x in outs[1:]:
        out = out.unionByName(x)
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, row_col: str | None = None) -> DataFrame:
    """id, size, source_size, target, taken (words, repeats counted) and copies of every row; and its row_col, if named: a
    unique long of docs, a staged table."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), row.alias("_row")), "mix")
    targets = stage(source_targets(rows, weights, share, max_copies).withColumn("grp", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "targets")
    rows = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    same = F.concat_ws("|", F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null")), "size", "grp")
    rows = rows.withColumn("_same", F.md5(same))
    again = stage(rows.groupBy("_same").count().where("count > 1").select("_same", F.lit(True).alias("_again")), "repeated")
    rows = join_bounded(join_bounded(rows, again, ["_same"]), targets, ["grp"])
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(p + 1e-12)
    ident = F.when(F.col("_again"), F.concat_ws("|", "_same", "_row")).otherwise(F.col("_same"))
    rows = rows.select("_row", "id", "size", "source_size", "target", "grp", base.alias("base"), F.greatest(F.lit(0.0), p - base).alias("fraction"), F.unhex(F.md5(ident)).alias("key"), F.xxhash64(ident).alias("h1"))
    rows = rows.withColumn("mix", F.shiftrightunsigned("h1", 1)).withColumn("draw", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    rows = stage(rows.drop("h1"), "mix-rows")
    todo = rows.where((F.col("size") > 0) & (F.col("fraction") > 0)).select("key", "grp", "size", "fraction", "draw", "mix")
    extra = pivotal_round(todo)
    copies = F.col("base") + F.coalesce("extra", F.lit(0))
    own = [F.col("_row").alias(row_col)] if row_col else []
    return rows.join(extra, "key", "left").select(F.col("id").alias(id_col), *own, "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * copies).otherwise(0).cast("long").alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies"))


def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed corpus: every row of docs, also of null and repeated ids, as often as mix_sources takes it. Rows without words
    have no copies and go."""
    rows = stage(docs.withColumn("_sluice_row", F.monotonically_increasing_id()), "mixed")
    copies = mix_sources(rows, id_col, text_col, source_col, row_col="_sluice_row", **settings).where("copies > 0").select("_sluice_row", F.col("copies").alias("_sluice_n"))
    return rows.join(copies, "_sluice_row").withColumn("_sluice_copy", F.explode(F.sequence(F.lit(1), F.col("_sluice_n")))).select(*docs.columns)
