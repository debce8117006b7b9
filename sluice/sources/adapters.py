"""The warehouse tables as the entities of LLM traffic: requests, usage, verdict log, sessions, price anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """orders: key and user are the customer; F failed, O completed, else processing; two numbers derived from the key."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("key_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("processing").alias("status"),
        (F.col("o_orderkey") % 5 != 0).alias("stream"), (100 + F.col("o_orderkey") % 4000).alias("latency_ms"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 900).alias("ttft_ms"), F.col("o_orderpriority").alias("source"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem: channel is the supplier, model the part; cost is the discounted price."""
    money = lambda c: F.col(c).cast("decimal(15,2)")
    q = F.col("l_quantity").cast("long")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("created_at"), F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").alias("model_id"),
        (q * 100).alias("input_tokens"), (q * 10 + F.col("l_linenumber")).alias("output_tokens"), (q * (money("l_discount") * 100).cast("long")).alias("cached_tokens"),
        (money("l_extendedprice") * (1 - money("l_discount"))).cast("decimal(18,4)").alias("cost"),
    )


def verdict_log(spark: SparkSession, folder: str) -> DataFrame:
    """events in append order: layer is the type; error, hit and warned follow props.k."""
    k = F.get_json_object("props", "$.k").cast("int")
    err = k % 7 == 0
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("layer"), F.when(err, F.lit("unavailable")).alias("error"),
        F.when(~err, k % 3 == 0).alias("hit"), (k % 5 == 0).alias("warned"), F.when(k % 11 != 0, F.floor(F.col("value") * 10)).alias("latency_ms"), F.sha2(F.col("user_id").cast("string"), 256).alias("key_hash"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as router turns a minute apart: a score from the text's length, thinking and tool loops by content."""
    n = F.length("text")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session"), "turn", (F.col("turn") * F.when(F.col("conv_id") % 4 == 0, 1900).otherwise(600)).alias("at"), F.when(n % 13 != 0, (n % 101) / 100).alias("p"),
        (n > 0).alias("has_text"), (n % 17 == 0).alias("thinking"), (n % 19 == 0).alias("tool_loop"),
    )


#: The same adapters in SQL, for checks on another engine.
REQUESTS_SQL = """requests AS (SELECT o_orderkey AS request_id, o_orderdate AS created_at, o_custkey AS key_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS status,
 o_orderkey % 5 <> 0 AS stream, 100 + o_orderkey % 4000 AS latency_ms, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 900 END AS ttft_ms, o_orderpriority AS source FROM orders)"""
USAGE_SQL = """usage AS (SELECT l_orderkey AS request_id, l_linenumber AS line, l_shipdate AS created_at, l_suppkey AS channel_id, l_partkey AS model_id, CAST(l_quantity AS BIGINT) * 100 AS input_tokens, CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS output_tokens,
 CAST(l_quantity AS BIGINT) * CAST(CAST(l_discount AS DECIMAL(15,2)) * 100 AS BIGINT) AS cached_tokens, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(18,4)) AS cost FROM lineitem)"""
LOG_SQL = """log AS (SELECT event_id AS seq, ts, event_type AS layer, CASE WHEN k % 7 = 0 THEN 'unavailable' END AS error, CASE WHEN k % 7 <> 0 THEN k % 3 = 0 END AS hit, k % 5 = 0 AS warned,
 CASE WHEN k % 11 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS latency_ms, sha256(CAST(user_id AS VARCHAR)) AS key_hash FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
TURNS_SQL = """turns AS (SELECT conv_id AS session, turn, turn * CASE WHEN conv_id % 4 = 0 THEN 1900 ELSE 600 END AS "at", CASE WHEN length(text) % 13 <> 0 THEN (length(text) % 101) / 100.0::DOUBLE END AS p,
 length(text) > 0 AS has_text, length(text) % 17 = 0 AS thinking, length(text) % 19 = 0 AS tool_loop FROM conversations)"""
