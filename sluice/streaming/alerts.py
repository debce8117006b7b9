"""Alerts whose state advances only when they were delivered.

Every micro-batch of a stream of findings goes through three tables under one folder, each written by batch number, so that a
batch that runs again finds what it has done: ``outbox`` holds the batch's alerts, worked out from the states before it;
``delivered`` those that went out, recorded slice by slice; ``state`` each key's last state after the batch. A key whose
alert didn't go out keeps its old state, and its next finding alerts again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slices of a batch's alerts that are delivered and recorded one after the other.
SLICES = 8


class Ledger:
    """The three tables of a stream of alerts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self, table: str, number: int) -> bool:
        """Whether a batch of a table was written whole."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/batch={number}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        at = f"{self.path}/{table}/batch={number}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def read(self, table: str, *numbers: int) -> DataFrame | None:
        """What was written whole of some batches of a table; None if nothing was."""
        done = [f"{self.path}/{table}/batch={n}" for n in numbers if self._done(table, n)]
        return self.spark.read.parquet(*done) if done else None


def batch_flips(found: DataFrame, state: DataFrame | None, key: str, order: str) -> DataFrame:
    """key, order, bad, action (alert, recover) where a key's finding differs from the one before it; before its first finding
    a key has its state's, or is good."""
    w = Window.partitionBy(key).orderBy(order)
    rows = found.select(key, order, F.coalesce("bad", F.lit(False)).alias("bad"))
    rows = rows.join(state.select(key, F.col("bad").alias("_state")), key, "left") if state is not None else rows.withColumn("_state", F.lit(False))
    was = F.coalesce(F.lag("bad").over(w), "_state", F.lit(False))
    return rows.withColumn("_was", was).where("bad <> _was").select(key, order, "bad", F.when(F.col("bad"), "alert").otherwise("recover").alias("action"))


def after_delivery(found: DataFrame, state: DataFrame | None, outbox: DataFrame, sent: DataFrame, key: str, order: str) -> DataFrame:
    """key, bad: each key's last finding; keys with an alert that wasn't sent go back to before their first such alert."""
    last = found.groupBy(key).agg(F.max_by(F.coalesce("bad", F.lit(False)), order).alias("bad"))
    missed = outbox.join(sent.select(key, order), [key, order], "left_anti").groupBy(key).agg(F.min_by("bad", order).alias("_not"))
    new = last.join(missed, key, "left").select(key, F.coalesce(~F.col("_not"), F.col("bad")).alias("bad"))
    return new if state is None else new.unionByName(state.select(key, "bad").join(new.select(key), key, "left_anti"))


def deliver_batch(ledger: Ledger, deliver: Callable[[DataFrame], DataFrame | None], key: str, order: str, slices: int = SLICES) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. ``deliver`` gets a slice of alerts and returns those that went out, None for all of them; it may
    raise, after which the batch runs again and goes on with the slices that aren't recorded."""

    def run(found: DataFrame, number: int) -> None:
        found = found.select(key, order, "bad").persist()
        try:
            state = ledger.read("state", number - 1)
            outbox = ledger.read("outbox", number)
            if outbox is None:
                flips = batch_flips(found, state, key, order)
                outbox = ledger.write(flips.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")), "outbox", number)
            for k in [r[0] for r in outbox.select("slice").distinct().orderBy("slice").collect()]:  # at most ``slices``
                part = number * slices + k
                if ledger.read("delivered", part) is None:
                    mine = outbox.where(F.col("slice") == k).drop("slice")
                    went = deliver(mine)
                    ledger.write(mine if went is None else mine.join(went.select(key, order), [key, order], "left_semi"), "delivered", part)
            sent = ledger.read("delivered", *range(number * slices, (number + 1) * slices))
            sent = outbox.limit(0) if sent is None else sent
            ledger.write(after_delivery(found, state, outbox.drop("slice"), sent, key, order), "state", number)
        finally:
            found.unpersist()

    return run


def alert_stream(found: DataFrame, path: str, deliver: Callable[[DataFrame], DataFrame | None], key: str, order: str, slices: int = SLICES):
    """Writer of a stream of (key, order, bad) through a ledger under ``path``; start it with any trigger. Rows of a key must
    arrive in their order over batches; within a batch they are sorted."""
    ledger = Ledger(found.sparkSession, f"{path}/ledger")
    return found.writeStream.foreachBatch(deliver_batch(ledger, deliver, key, order, slices)).option("checkpointLocation", f"{path}/checkpoint").outputMode("append")
