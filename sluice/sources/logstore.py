"""The verdict log as a table of hours: appends, reads that prune, retention by dropping hours, rewriting of one hour.

Records stand under day=YYYY-MM-DD/hour=H by their time. Retention deletes the folders of hours that are over and rewrites the
one hour that the cutoff cuts, so its cost doesn't grow with what stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.scratch import staged


class LogStore:
    """A partitioned log under a path. Records need ts, a timestamp (without zone); records without one are kept under the
    day ``__HIVE_DEFAULT_PARTITION__`` and never dropped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _placed(self, records: DataFrame) -> DataFrame:
        return records.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")})

    def append(self, records: DataFrame) -> None:
        """Adds records; each hour's go to one file of the append."""
        rows = self._placed(records)
        rows.repartition("day", "hour").write.mode("append").partitionBy("day", "hour").parquet(self.path)

    def read(self, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """Records from start to before end, timestamps; only the days between are read."""
        df = self.spark.read.parquet(self.path)
        for bound, after in ((start, True), (end, False)):
            if bound is not None:
                df = df.where((F.col("day") >= F.to_date(bound)) & (F.col("ts") >= bound) if after else (F.col("day") <= F.to_date(bound)) & (F.col("ts") < bound))
        return df.drop("day", "hour")

    def hours(self) -> DataFrame:
        """day, hour of the hours there are, from the folders' names alone."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/day=*/hour=*")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        names = [s.getPath().toString().split("/")[-2:] for s in found or []]
        rows = [(d.partition("=")[2], int(h.partition("=")[2])) for d, h in names if "__HIVE" not in d + h]  # one an hour
        return self.spark.createDataFrame(rows, "day string, hour int").select(F.to_date("day").alias("day"), "hour")

    def retain(self, cutoff: Column) -> int:
        """Drops what is older than the cutoff, a timestamp; the number of hours dropped whole. Running again changes nothing."""
        begin = F.make_timestamp_ntz(F.year("day"), F.month("day"), F.dayofmonth("day"), F.col("hour"), F.lit(0), F.lit(0))
        limit = cutoff.cast("timestamp_ntz")
        hours = self.hours().select("day", "hour", (begin + F.expr("INTERVAL 1 HOUR") <= limit).alias("over"), ((begin < limit) & (begin + F.expr("INTERVAL 1 HOUR") > limit)).alias("cut")).where("over or cut").collect()
        for h in (h for h in hours if h.cut):
            self.rewrite(str(h.day), h.hour, F.col("ts") >= limit)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        over = [h for h in hours if h.over]
        for h in over:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={h.day}/hour={h.hour}")
            at.getFileSystem(conf).delete(at, True)
        return len(over)

    def rewrite(self, day: str, hour: int, keep: Column | None = None) -> None:
        """One hour's records again, in one file and only those to keep; other hours aren't touched."""
        own = self.spark.read.parquet(self.path).where((F.col("day") == F.lit(day).cast("date")) & (F.col("hour") == hour))
        rows = staged(own if keep is None else own.where(keep), "log-hour")
        if rows.isEmpty():
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={day}/hour={hour}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            return
        rows.repartition("day", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(self.path)

    def preview(self, cutoff: Column) -> DataFrame:
        """n, cutoff: how many records retention would drop; days on one side of the cutoff are counted from the files' metadata."""
        limit = cutoff.cast("timestamp_ntz")
        df = self.spark.read.parquet(self.path).where(F.col("day") <= F.to_date(limit))
        return df.agg(F.count_if(F.col("ts") < limit).alias("n")).select("n", limit.alias("cutoff"))
