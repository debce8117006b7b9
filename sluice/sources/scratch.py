"""Tables that cut lineage: written once to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder; a temporary one only in local mode where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return f"{base.rstrip('/')}/sluice-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back; it goes when the application ends."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)
