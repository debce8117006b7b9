"""Helpers shared by the operators: scratch tables, bounded broadcasts and prefix sums.

Scratch tables are Parquet folders under ``spark.checkpoint.dir``, which all executors share, so lost
executors can be replaced without recomputing what stands before a table. They are removed when the
application ends.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join with at most so many (narrow) rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: Rows and bytes of an Arrow batch handed to Python; bounds a task's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20

_LOCAL: list[str] = []
#: Scratch tables of the pipeline stage that ran last, and whether one is being built.
_HELD: list[DataFrame] = []
_BUILDING: list[bool] = []


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches for long texts; Spark reads these settings when a query runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, as in tests, a temporary one, in local mode only: on a cluster each
    executor would write to its own disk."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sluice-"))
    return "file://" + _LOCAL[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back: cuts the lineage, computes once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    if _BUILDING:
        _HELD.append(out)
    return out


def frees_scratch(step: Callable) -> Callable:
    """For stages of a pipeline: the scratch tables of the stage before go when the next one begins, for its result has been
    written by then. Tables made outside of stages aren't touched."""

    @functools.wraps(step)
    def run(*args):
        old, _HELD[:] = list(_HELD), []
        discard(*old)
        _BUILDING.append(True)
        try:
            return step(*args)
        finally:
            _BUILDING.pop()

    return run


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for t in tables:
        at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a staged table of one row per key: broadcast when its counted rows are within the bound, else a
    shuffled join, whose hot keys adaptive execution splits."""
    return big.join(F.broadcast(small) if small.count() <= limit else small, on, how)


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About 1.2 times ``rows`` rows by a hash of their keys; all, if there are fewer. What is then sorted and cut to the
    exact bound is small at any size."""
    n = df.count()
    share = min(1.0, (1.2 * rows + 50) / max(1, n))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(F.lit(29), *keys), F.lit(1 << 40)) < int(share * (1 << 40)))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


_MEMO: dict = {}


def memo(key, make):
    """A worker's one memo of words: made at first use, dropped when a task of another operator asks for its own, so
    that what operators keep doesn't add up in reused Python workers."""
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = make()
    return _MEMO[key]


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, partitions: int, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of ``order`` within ``group``, without putting a group
    into one task: rows are range-partitioned and sorted, each partition sums on its own, and the sums of the
    partitions before it are joined back. ``order`` must end in a unique column. ``df`` should be a staged
    table, for range partitioning samples it first. With one partition, for tables that the caller has counted, the sum is
    a window."""
    keys = [*group, *order]
    if partitions == 1:
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_in", T.LongType())])

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        pid, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            if group:
                cols = [b.column(b.schema.get_field_index(g)).to_pylist() for g in group]
                tags = list(zip(*cols, strict=True))
                start = 0
                sums = np.empty(len(v), np.int64)
                while start < len(tags):
                    end = start + 1
                    while end < len(tags) and tags[end] == tags[start]:
                        end += 1
                    base = total if tags[start] == last else 0
                    sums[start:end] = before[start:end] - before[start] + base
                    last, total, start = tags[start], int(sums[end - 1] + v[end - 1]), end
            else:
                sums = before + total
                total = int(sums[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * b.num_rows, pa.int32()), pa.array(sums)], names=[*b.schema.names, "_pid", "_in"])

    local = stage(df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), name)
    sums = local.groupBy(*group, "_pid").agg(F.sum(value).alias("_sum"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(sums.select(*group, "_pid", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base")), f"{name}-base")
    cond = local["_pid"] == base["_pid"]
    for g in group:
        cond = cond & local[g].eqNullSafe(base[g])
    small = F.broadcast(base) if base.count() <= BROADCAST_ROWS else base
    return local.join(small, cond, "left").select(*[local[c] for c in df.columns], (local["_in"] + base["_base"]).alias(out))
