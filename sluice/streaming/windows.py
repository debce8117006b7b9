"""Event time: sessions as windows that grow, and requests joined with their usage while both stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_islands(turns: DataFrame, ttl: int = 3600, lateness: str = "0 seconds") -> DataFrame:
    """session, first_at, last_at, turns of a stream of turns: runs of a session's turns without a gap of more than ``ttl``
    seconds, the islands of the batch router. ``at`` is whole seconds since 1970. An island is written once the watermark,
    ``lateness`` behind the newest turn, has passed its end; then its state goes."""
    rows = turns.where("session is not null").select("session", "at", F.timestamp_seconds("at").alias("_at")).withWatermark("_at", lateness)
    # a gap of exactly ttl seconds still belongs to the session
    window = F.session_window("_at", f"{ttl * 1000 + 1} milliseconds")
    return rows.groupBy("session", window.alias("_w")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("turns")).drop("_w")


def requests_with_usage(requests: DataFrame, usage: DataFrame, within: str = "125 days", lateness: str = "1 day") -> DataFrame:
    """request_id, hour (the request's), source, input_tokens, output_tokens of each usage row that comes up to ``within``
    after its request. Both sides are streams of their own; what can't meet any more, by their watermarks and the bound, leaves
    the join's state, so usage that comes later is left out."""
    r = requests.select(F.col("request_id").alias("_request"), F.col("created_at").cast("timestamp").alias("_made"), "source").withWatermark("_made", lateness)
    u = usage.select("request_id", F.col("created_at").cast("timestamp").alias("_used"), "input_tokens", "output_tokens").withWatermark("_used", lateness)
    meets = (F.col("request_id") == F.col("_request")) & (F.col("_used") >= F.col("_made")) & (F.col("_used") <= F.col("_made") + F.expr(f"INTERVAL {within}"))
    return u.join(r, meets).select("request_id", F.date_trunc("hour", "_made").alias("hour"), "source", "input_tokens", "output_tokens")
