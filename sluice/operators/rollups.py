"""Roll-ups: all dimensions of usage from one scan, and latency quantiles from sketches that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import usage as U
from sluice.sources import scratch

#: Size parameter of the quantile sketches, and the error of a rank that it allows in nearly all cases.
SKETCH_K, RANK_ERROR = 400, 0.01


def token_measures() -> list[Column]:
    """U.measures with reasoning tokens and cached tokens that were written."""
    return [*U.measures(), U.total("reasoning_tokens").alias("reasoning_tokens"), U.total("written_tokens").alias("written_tokens")]


def usage_sums(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n rows and sums, for summed_measures."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "written_tokens", "cost")))


def summed_measures() -> list[Column]:
    """token_measures of rows that are sums of n rows."""
    return [U.total("n").alias("requests"), *token_measures()[1:]]


def dimension_report(df: DataFrame, dimensions: dict[str, str], measures: list[Column] | None = None, overall: bool = True) -> DataFrame:
    """dimension, key (as text) and measures for every value of every dimension, and with ``overall`` one row of dimension ``all``:
    grouping sets over one scan. A null key is a key of its own; no rows give no rows."""
    columns = list(dimensions.values())
    rows = df.groupingSets([[c] for c in columns] + [[]] * overall, *columns).agg(*(measures or token_measures()), *[F.grouping(c).alias(f"_{k}") for k, c in enumerate(columns)])
    name, key = F.lit("all"), F.lit(None).cast("string")
    for k, (d, c) in enumerate(dimensions.items()):
        name, key = F.when(F.col(f"_{k}") == 0, d).otherwise(name), F.when(F.col(f"_{k}") == 0, F.col(c).cast("string")).otherwise(key)
    values = [x for x in rows.columns if x not in columns and not (x.startswith("_") and x[1:].isdigit())]
    return rows.select(name.alias("dimension"), key.alias("key"), *values)


def request_dimension_report(usage: DataFrame, requests: DataFrame, of_usage: dict[str, str], of_request: dict[str, str]) -> DataFrame:
    """dimension_report of usage joined with requests by request_id, whose dimensions are columns of usage and of requests.

    Usage is summed by request before the join. Where each request of usage stands in requests once, dimensions of usage need no join:
    they are summed where their rows lie, instead of after a shuffle that deals the rows of a channel or model over all tasks."""
    asked = requests.select("request_id", *of_request.values(), F.lit(True).alias("_known"))
    met = usage_sums(usage, "request_id").join(asked, "request_id", "left").withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("request_id")))
    met = scratch.staged(met.select("n", "input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "written_tokens", "cost", *of_request.values(), "_known", "_times"), "request-sums")
    once = met.where("_known is null or _times > 1").isEmpty()
    rows = usage if once else usage.join(requests.select("request_id"), "request_id")
    return dimension_report(rows, of_usage, overall=False).unionByName(dimension_report(met.where("_known"), of_request, summed_measures()))


def latency_sketches(log: DataFrame, unit: str = "hour", value: str = "latency_ms") -> DataFrame:
    """layer, start, n, sketch of the latencies of each hour (or day): what a log keeps of them for good. Rows without a
    latency don't count."""
    rows = log.where(F.col(value).isNotNull())
    return rows.groupBy("layer", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(SKETCH_K)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, n, sketch: sketches of coarser groups, without a look at the rows."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("sketch"))


def sketch_percentile(sketch: Column, q: float) -> Column:
    """A value whose rank among a sketch's values is q, within RANK_ERROR."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(q))


def daily_latency(sketches: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """layer, day, n and one column a percentile, p50 and p95, from hourly sketches."""
    days = merged_sketches(sketches, "layer", F.to_date("start").alias("day"))
    return days.select("layer", "day", "n", *[sketch_percentile(F.col("sketch"), q).alias(f"p{round(100 * q)}") for q in percentiles])


def rank_errors(log: DataFrame, days: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95), value: str = "latency_ms") -> DataFrame:
    """layer, day, n and how far each percentile's rank, a range where values repeat, is from the one asked for."""
    rows = log.where(F.col(value).isNotNull()).select("layer", F.to_date("ts").alias("day"), F.col(value).alias("_v")).join(days, ["layer", "day"])
    out = []
    for q in percentiles:
        p = F.col(f"p{round(100 * q)}")
        low, high = F.count_if(F.col("_v") < p) / F.count(F.lit(1)), F.count_if(F.col("_v") <= p) / F.count(F.lit(1))
        out.append(F.greatest(F.lit(0.0), low - q, q - high).alias(f"error_p{round(100 * q)}"))
    return rows.groupBy("layer", "day").agg(F.count(F.lit(1)).alias("n"), *out)
