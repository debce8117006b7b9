"""Usage analytics: filters, totals, dimensions, rankings, shares and series over requests and usage rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, start: str | None = None, end: str | None = None, at: str = "created_at", **lists: Sequence) -> DataFrame:
    """Rows in [start, end] whose columns are in the lists given; an empty list doesn't filter."""
    if start:
        df = df.where(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(at) <= F.lit(end).cast("timestamp_ntz"))
    for column, values in lists.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def money(c: str = "cost") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def measures() -> list[Column]:
    """Requests, tokens by kind and cost."""
    return [
        F.count(F.lit(1)).alias("requests"), total("input_tokens").alias("input_tokens"), total("cached_tokens").alias("cached_tokens"),
        (total("input_tokens") - total("cached_tokens")).alias("uncached_tokens"), total("output_tokens").alias("output_tokens"),
        (total("input_tokens") + total("output_tokens")).alias("total_tokens"), money().alias("cost"),
    ]


def overview(df: DataFrame) -> DataFrame:
    return df.agg(*measures())


def by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(*measures())


def daily(df: DataFrame, at: str = "created_at") -> DataFrame:
    return by(df, F.to_date(at).alias("date"))


def hourly(df: DataFrame, day: str | DataFrame, at: str = "created_at") -> DataFrame:
    """Requests by hour of a day, given as text or as a table of one row."""
    rows = df.where(F.to_date(at) == F.lit(day).cast("date")) if isinstance(day, str) else df.join(F.broadcast(day.select("day")), F.to_date(at) == F.col("day"))
    return rows.groupBy(F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("requests"))


def window_start(now: str, unit: str) -> Column | None:
    """Start of the day, week or month of ``now``; None for all time."""
    return None if unit == "all" else F.date_trunc(unit, F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")


def request_overview(df: DataFrame, now: str) -> DataFrame:
    """Counts over all, today, this and last week and this month up to ``now``, failures and mean latency."""
    t, at = F.lit(now).cast("timestamp_ntz"), F.col("created_at")
    week = window_start(now, "week")
    return df.where(at <= t).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(at >= window_start(now, "day")).alias("today"), F.count_if(at >= week).alias("this_week"),
        F.count_if((at >= week - F.expr("INTERVAL 7 DAYS")) & (at < week)).alias("last_week"), F.count_if(at >= window_start(now, "month")).alias("this_month"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(F.col("status") == "completed", F.col("latency_ms"))), 4).alias("avg_latency_ms"),
    )


def token_matrix(df: DataFrame, now: str) -> DataFrame:
    """Input, output and cached tokens over today, week, month and all time, and the last row's time."""
    t, at = F.lit(now).cast("timestamp_ntz"), F.col("created_at")
    cols = []
    for unit in ("day", "week", "month", "all"):
        start = window_start(now, unit)
        for c in ("input", "output", "cached"):
            v = F.col(f"{c}_tokens")
            cols.append(F.coalesce(F.sum(F.when(at >= start, v) if start is not None else v), F.lit(0)).cast("long").alias(f"{c}_{unit}"))
    return df.where(at <= t).agg(*cols, F.max("created_at").alias("last_updated"))


def success_rates(executions: DataFrame, key: str) -> DataFrame:
    """Successes, failures and the rate in percent of finished rows by key."""
    ok, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return executions.groupBy(key).agg(ok.alias("success"), bad.alias("failed"), (ok + bad).alias("finished"), F.round(F.try_divide(ok * 100, ok + bad), 4).alias("success_rate"))


def top(df: DataFrame, by_column: str, tie: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(by_column), tie).limit(n)


def share_of_shown(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """The first n rows with their share, in percent, of the sum over those n."""
    return top(df, value, tie, n).withColumn("share", F.round(100 * F.col(value) / F.sum(value).over(Window.partitionBy()), 4))


def top_and_other(df: DataFrame, label: str, value: str, keep: int = 9, least_percent: float = 2.0) -> DataFrame:
    """label, value and percent: at most ``keep`` labels of least_percent or more, the rest summed as Other."""
    whole = df.agg(F.sum(value).alias("_all"))
    first = df.orderBy(F.desc(value), label).limit(keep).join(F.broadcast(whole), F.lit(True)).where(100 * F.col(value) >= least_percent * F.col("_all"))
    shown = first.agg(F.coalesce(F.sum(value), F.lit(0)).alias("_shown"))
    other = whole.join(F.broadcast(shown), F.lit(True)).where(F.col("_all") > F.col("_shown")).select(F.lit("Other").alias(label), (F.col("_all") - F.col("_shown")).alias(value), "_all")
    rows = first.select(F.col(label).cast("string").alias(label), value, "_all").unionByName(other)
    return rows.select(label, value, F.round(100 * F.col(value) / F.col("_all"), 4).alias("percent"))


def tokens_per_second() -> Column:
    """Of a request: completion tokens over the time after the first token, when streamed, else over all of it."""
    latency, ttft, out = F.col("latency_ms"), F.col("ttft_ms"), F.col("output_tokens")
    effective = F.when(F.col("stream") & (ttft <= latency), latency - ttft).otherwise(latency)
    effective = F.when(effective <= 0, 10).otherwise(effective)
    return F.when((latency > 0) & (out > 0), out * 1000.0 / effective)


def window_of(now: str, name: str) -> tuple[str | None, str | None]:
    """Bounds, as text, of a named window up to ``now``: day, week, month, allTime, or custom:<from>,<to> with the epoch and now for
    what is left out. Either end may be None."""
    if name.startswith("custom:"):
        start, _, end = name.removeprefix("custom:").partition(",")
        return start or "1970-01-01 00:00:00", end or now
    if name == "allTime":
        return None, None
    import datetime

    day = datetime.datetime.fromisoformat(now).replace(hour=0, minute=0, second=0, microsecond=0)
    back = {"day": 0, "week": day.weekday(), "month": day.day - 1}[name]
    return str(day - datetime.timedelta(days=back)), None


def performance(speeds: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """date, key, mean throughput (null if no request has one), mean time to the first token, requests."""
    return speeds.groupBy(F.to_date(at).alias("date"), key).agg(F.round(F.avg("tps"), 4).alias("throughput"), F.round(F.avg("ttft_ms"), 4).alias("ttft_ms"), F.count(F.lit(1)).alias("requests"))


def fastest(speeds: DataFrame, key: str, n: int = 5) -> DataFrame:
    """key, throughput (output tokens a second over all its requests), tokens, mean latency and requests of the n fastest."""
    per = speeds.where((F.col("latency_ms") > 0) & (F.col("output_tokens") > 0)).groupBy(key).agg(F.round(F.sum("output_tokens") * 1000.0 / F.sum("latency_ms"), 4).alias("throughput"), F.sum("output_tokens").alias("tokens"), F.round(F.avg("latency_ms"), 4).alias("latency_ms"), F.count(F.lit(1)).alias("requests"))
    return top(per, "throughput", key, n)


def channel_rates(executions: DataFrame, channels: DataFrame, key: str = "channel_id") -> DataFrame:
    """success_rates with the channels' type and whether they are off; channels without executions are left out."""
    return success_rates(executions, key).join(channels.select(key, "type", "disabled"), key, "left")


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by weight; a missing value counts as 0 with its whole weight; 0 where the weights sum to 0."""
    return F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(weight)), F.sum(weight)), F.lit(0.0))


def axis_cap(values: Column, n: Column, floor: int = 10, most: int = 1000) -> Column:
    """Upper end of a chart's axis: of more than ten values the one at index floor(0.9 n), else the largest, with a tenth more.
    ``values``: percentile-free, the sorted array."""
    at = F.when(n > 10, F.element_at(values, (F.floor(n * 0.9) + 1).cast("int"))).otherwise(F.element_at(values, -1))
    return F.least(F.lit(most), F.greatest(F.lit(floor), F.ceil(at * 1.1)))


def gap_filled(series: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Every key on every date of the data: 0 before its first and after its last date, null in between. The dates, one row of
    days or months, are exploded by key."""
    days = series.agg(F.collect_set(date).alias("_days"))
    span = series.groupBy(key).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    grid = span.join(F.broadcast(days), F.lit(True)).withColumn(date, F.explode("_days"))
    return grid.join(series, [key, date], "left").select(key, date, F.when(F.col(value).isNull() & ((F.col(date) < F.col("_from")) | (F.col(date) > F.col("_to"))), 0).otherwise(F.col(value)).alias(value))


def growth(now: Column, before: Column) -> Column:
    """Percent change; from nothing 100 if anything, else 0."""
    return F.when(before == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise((now - before) * 100.0 / before)


def nested_usage(df: DataFrame, key: str, model: str = "model_id", most: int = 3) -> DataFrame:
    """Tokens by key and, as text, its models of most tokens."""
    per = df.groupBy(key, model).agg(total("input_tokens").alias("i"), total("output_tokens").alias("o"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.col("i") + F.col("o")), model)))
    names = F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", F.col(model).cast("string").alias("m")))))
    return ranked.groupBy(key).agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.array_join(F.transform(names, lambda x: x["m"]), ",").alias("top_models"))


def health(points: DataFrame, key: str, at: str, most: int = 15) -> DataFrame:
    """Class of each key's last points: idle without requests, healthy from 90 percent success, warning from 50."""
    last = points.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where(F.col("_r") <= most)
    s = last.groupBy(key).agg(F.sum("total").alias("total"), F.sum("success").alias("success"))
    rate = F.try_divide(F.col("success"), F.col("total"))
    return s.withColumn("health", F.when(F.col("total") == 0, "idle").when(rate >= 0.9, "healthy").when(rate >= 0.5, "warning").otherwise("error"))
