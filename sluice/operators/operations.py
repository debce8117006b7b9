"""The operational side: verdict-log statistics, alerts, quotas, keys, session routing, prices, cards and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.ordering import literal, nth


# --- verdict log ---------------------------------------------------------------------------------------------------
def last_n(log: DataFrame, n: int, layer: str = "layer") -> DataFrame:
    """Each layer's newest n rows in append order."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(layer).orderBy(F.desc("seq")))).where(F.col("_r") <= n).drop("_r")


def log_stats(log: DataFrame, n: int) -> DataFrame:
    """Of each layer's newest n rows: counts, error rate, and the mean latency of rows without an error, cut to an integer."""
    ok = F.col("error").isNull()
    mean = F.try_divide(F.sum(F.when(ok, F.col("latency_ms"))), F.count(F.when(ok, F.col("latency_ms"))))
    return last_n(log, n).groupBy("layer").agg(
        F.count(F.lit(1)).alias("total"), F.count("error").alias("errors"), F.round(F.count("error") / F.count(F.lit(1)), 4).alias("error_rate"),
        F.count_if("hit").alias("hits"), F.count_if("warned").alias("warned"), F.floor(mean).cast("long").alias("avg_latency_ms"), F.max_by("ts", "seq").alias("last_ts"),
    )


def unavailable(stats: DataFrame, least: int = 4, rate: float = 0.5) -> DataFrame:
    return stats.withColumn("bad", (F.col("total") >= least) & (F.col("error_rate") >= rate))


def flips(cycles: DataFrame, key: str, order: str, bad: str = "bad") -> DataFrame:
    """Rows where a key turns bad (alert) or good again (recover); before its first row a key is good."""
    before = F.lag(bad, 1, False).over(Window.partitionBy(key).orderBy(order))
    action = F.when(F.col(bad) & ~before, "alert").when(~F.col(bad) & before, "recover")
    return cycles.withColumn("action", action).where("action is not null")


def pending(log: DataFrame, cursor: DataFrame, newest: int = 100, most: int = 10) -> DataFrame:
    """The oldest ``most`` rows after the cursor, a table of one row, among the newest ``newest``."""
    rows = log.orderBy(F.desc("seq")).limit(newest)
    return rows.join(F.broadcast(cursor.select("cursor")), F.col("ts") > F.col("cursor")).drop("cursor").orderBy("seq").limit(most)


def tail(log: DataFrame, n: int, layer: str | None = None) -> DataFrame:
    """Newest rows first, 1 to 500 of them."""
    rows = log.where(F.col("layer") == layer) if layer else log
    return rows.orderBy(F.desc("seq")).limit(max(1, min(500, n)))


def retained(log: DataFrame) -> DataFrame:
    """The newer half of the rows, the larger one of an odd count: those from the middle seq on, which is found by narrowing
    ranges instead of a sort."""
    n = log.count()
    if not n:
        return log
    return log.where(F.col("seq") >= literal(log, "seq", nth(log, ["seq"], n // 2)[0]))


def enrich(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds name and user of the key whose SHA-256 a row carries; others stay as they are."""
    known = keys.select(F.sha2(F.col("key").cast("string"), 256).alias("key_hash"), "key_name", "user_name")
    return log.join(known, "key_hash", "left")


def bypass_match(entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Enabled bypass entries of the tokens given."""
    return tokens.withColumn("id", F.sha2(F.col("token").cast("string"), 256)).join(entries.where("enabled"), "id").select("token", "label", "scope", "layers")


# --- quotas ---------------------------------------------------------------------------------------------------------
def quota_ratios(usage: DataFrame) -> DataFrame:
    """(key, dim, ratio) of used_* over quota_*; dims without a positive quota are left out."""
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"used_{d}").cast("double").alias("used"), F.col(f"quota_{d}").cast("double").alias("quota")) for d in ("requests", "tokens", "credits")])
    return usage.select("key_id", F.explode(dims).alias("x")).where("x.quota > 0").select("key_id", "x.dim", F.round(F.col("x.used") / F.col("x.quota"), 6).alias("ratio"))


def quota_class(ratios: DataFrame, near: float = 0.8) -> DataFrame:
    """over if any ratio is 1 or more, near if any is ``near`` or more, else ok."""
    most = F.max("ratio")
    return ratios.groupBy("key_id").agg(most.alias("highest"), F.when(most >= 1, "over").when(most >= near, "near").otherwise("ok").alias("state"))


def quota_progress(used_cost: Column, quota_cost: Column, used_tokens: Column, quota_tokens: Column, used_requests: Column, quota_requests: Column) -> Column:
    """Percent of the first quota set, of cost, tokens, requests; 0 where it isn't positive."""
    pick = lambda u, q: F.when(q > 0, 100.0 * u / q).otherwise(0.0)
    return F.when(quota_cost.isNotNull(), pick(used_cost, quota_cost)).when(quota_tokens.isNotNull(), pick(used_tokens, quota_tokens)).when(quota_requests.isNotNull(), pick(used_requests, quota_requests)).otherwise(0.0)


def meter(percent: Column) -> Column:
    return F.when(percent >= 100, "over").when(percent >= 80, "warning").otherwise("normal")


def elapsed_percent(start: Column, end: Column, now: Column) -> Column:
    """How much of a period is over, 0 to 100; null without a period."""
    s = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.when(end > start, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (s(now) - s(start)) / (s(end) - s(start)))))


# --- requests for keys ----------------------------------------------------------------------------------------------
def expired(rows: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Pending requests older than ``hours`` become expired."""
    old = (F.col("status") == "pending") & (F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return rows.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def trimmed(rows: DataFrame, most: int) -> DataFrame:
    """All pending rows and the newest others, ``most`` in all; the oldest others go first. The last one that goes is found by
    narrowing ranges, so nothing is sorted or joined. created_at and request_id aren't null."""
    other = F.col("status") != "pending"
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(other).alias("done")).first()
    drop = min(counts.done, max(0, counts.n - most))
    if not drop:
        return rows
    at, request = (literal(rows, c, v) for c, v in zip(("created_at", "request_id"), nth(rows.where(other), ["created_at", "request_id"], drop - 1), strict=True))
    gone = other & ((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("request_id") <= request)))
    return rows.where(~F.coalesce(gone, F.lit(False)))


# --- session routing ------------------------------------------------------------------------------------------------
def route(turns: DataFrame, threshold: float = 0.5, escalate: float = 0.85, ttl: int = 3600) -> DataFrame:
    """Tier and reason of every turn, with a session's tier kept while no gap exceeds ttl seconds.

    turns: session, turn, at (seconds), p (score or null), has_text, thinking, tool_loop. A session's tier never falls: it
    is set by the first turn that is scored, isn't a tool loop and isn't a simple one with thinking, and rises at a later
    confident turn. Both are running maxima within an island of turns, so no row needs a loop."""
    w = Window.partitionBy("session").orderBy("at", "turn")
    new = F.when(F.col("at") - F.lag("at").over(w) > ttl, 1).otherwise(0)
    df = turns.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = Window.partitionBy("session", "island").orderBy("at", "turn")
    before, upto = i.rowsBetween(Window.unboundedPreceding, -1), i.rowsBetween(Window.unboundedPreceding, 0)
    p = F.when((F.col("p") >= 0) & (F.col("p") <= 1), F.col("p"))
    scored = F.col("has_text") & p.isNotNull() & ~F.col("tool_loop") & F.col("session").isNotNull()
    stores = scored & ((p >= threshold) | ~F.col("thinking"))
    df = df.withColumn("_p", p).withColumn("_stores", stores).withColumn("_started", F.coalesce(F.max(F.col("_stores").cast("int")).over(before), F.lit(0)) == 1)
    first = F.col("_stores") & ~F.col("_started")
    rises = (first & (p >= threshold)) | (F.col("_started") & scored & (p >= escalate) & ~F.col("thinking"))
    df = df.withColumn("_rises", rises).withColumn("_was", F.coalesce(F.max(F.col("_rises").cast("int")).over(before), F.lit(0)) == 1).withColumn("_now", F.coalesce(F.max(F.col("_rises").cast("int")).over(upto), F.lit(0)) == 1)
    kept = F.when(F.col("_was"), "complex").when(F.col("_started"), "simple")
    after = F.when(F.col("_now"), "complex").when(F.col("_started") | F.col("_stores"), "simple")
    usable = F.col("has_text") & p.isNotNull()
    alone = F.when(p >= threshold, "complex").otherwise("simple")
    tier = F.when(F.col("tool_loop"), kept).when(F.col("_was"), "complex").when(~usable, F.lit(None)).when(F.col("_started"), after).when((p < threshold) & F.col("thinking"), F.lit(None)).otherwise(alone)
    reason = F.when(F.col("tool_loop"), "tool_loop_lock").when(F.col("_was"), "session_inherit").when(~usable, "fail_open").when(
        F.col("_started"), F.when((p >= escalate) & F.col("thinking"), "thinking_lock").when(p >= escalate, "escalate").otherwise("session_inherit")
    ).when((p < threshold) & F.col("thinking"), "thinking_lock").otherwise("classify")
    return df.select("session", "turn", tier.alias("tier"), reason.alias("reason"))


# --- prices ---------------------------------------------------------------------------------------------------------
def same_price(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))


def price_drift(anchors: DataFrame, catalog: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """model, state (same, drift, manual) and both prices. anchors: model, alias (provider:model or null), prompt,
    completion, cached; catalog: provider, model, input, output, cache_read. A model's provider is its alias's, else that
    of the first prefix; without a catalog row with both prices it is kept by hand. A missing cache price is the input's."""
    aliased = F.col("alias").isNotNull()
    provider = F.when(aliased, F.substring_index("alias", ":", 1))
    for prefix, name in prefixes:
        provider = provider.when(F.col("model").startswith(prefix), F.lit(name))
    name = F.when(aliased, F.substring_index("alias", ":", -1)).otherwise(F.element_at(F.split("model", "/"), -1))
    a = anchors.withColumn("_provider", provider).withColumn("_name", name)
    c = catalog.where("input is not null and output is not null").select(F.col("provider").alias("_provider"), F.col("model").alias("_name"), F.col("input").alias("new_prompt"), F.col("output").alias("new_completion"), F.coalesce("cache_read", "input").alias("new_cached"))
    j = a.join(c, ["_provider", "_name"], "left")
    same = same_price(F.col("prompt"), F.col("new_prompt")) & same_price(F.col("completion"), F.col("new_completion")) & same_price(F.col("cached"), F.col("new_cached"))
    return j.select("model", F.when(F.col("new_prompt").isNull(), "manual").when(same, "same").otherwise("drift").alias("state"), "prompt", "new_prompt")


def channel_prices(channels: DataFrame, anchors: DataFrame) -> DataFrame:
    """Prices of a channel's models, anchor times multiplier, as text without trailing zeros; a missing anchor is an error."""
    j = channels.join(anchors, channels["canonical"] == anchors["model"], "left")
    text = lambda c: F.regexp_replace((c.cast("decimal(18,6)") * F.col("multiplier").cast("decimal(12,6)")).cast("decimal(30,12)").cast("string"), r"\.?0+$", "")
    checked = F.when(anchors["model"].isNull(), F.raise_error(F.concat(F.lit("no anchor for "), channels["canonical"])).cast("double")).otherwise(F.col("prompt"))
    return j.select("channel", "alias", text(checked).alias("price"))


# --- configuration and cards ----------------------------------------------------------------------------------------
def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose values differ between two (path, value) tables; version and notes aside."""
    o, n = old.withColumnRenamed("value", "_o"), new.withColumnRenamed("value", "_n")
    return o.join(n, "path", "full").where(~F.col("_o").eqNullSafe(F.col("_n")) & (F.col("path") != "version") & ~F.col("path").startswith("_")).select("path")


def missing_pairs(required: DataFrame, existing: DataFrame, model: str, channel: str) -> DataFrame:
    """Per model the channels it should be linked to and isn't, as sorted text."""
    want = required.groupBy(model).agg(F.collect_set(channel).alias("_w"))
    have = existing.groupBy(model).agg(F.collect_set(channel).alias("_h"))
    gap = F.array_except("_w", F.coalesce("_h", F.array().cast(required.select(F.array(channel)).schema[0].dataType)))
    return want.join(have, model, "left").select(model, F.size(gap).alias("missing"), F.array_join(F.array_sort(gap), ",").alias("channels")).where("missing > 0")


# --- evaluation -----------------------------------------------------------------------------------------------------
def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts and accuracy, precision, recall to 4 places; null without a denominator."""
    e, p = F.col(expected), F.col(predicted)
    tp, fp, fn, tn = (F.count_if(c) for c in (e & p, ~e & p, e & ~p, ~e & ~p))
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp + tn, F.count(F.lit(1))).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"))


def threshold_sweep(rows: DataFrame, expected: str, score: str, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Detections and false alarms at each threshold, in one pass."""
    x = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    return rows.select(expected, score, x.alias("threshold")).groupBy("threshold").agg(F.count_if(F.col(expected) & (F.col(score) >= F.col("threshold"))).alias("detected"), F.count_if(~F.col(expected) & (F.col(score) >= F.col("threshold"))).alias("false_alarms"))


def water_levels(rows: DataFrame, category: str, expected: str, predicted: str) -> DataFrame:
    e, p = F.col(expected), F.col(predicted)
    return rows.groupBy(category).agg(F.count_if(e & p).alias("hit"), F.count_if(e).alias("positives"), F.count_if(~e & p).alias("false_alarms"), F.count(F.lit(1)).alias("total"))


def nearest_percentile(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """The value at index floor(n q), the last at most, of each key's sorted values. Rows are counted by value first, so a key's
    running sum goes over its distinct values, whole milliseconds in a log."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    upto, n = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), F.sum("_n").over(w)
    r = counts.withColumn("_upto", upto).withColumn("_all", n)
    return r.where(F.col("_upto") > F.least(F.col("_all") - 1, F.floor(F.col("_all") * q))).groupBy(key).agg(F.min(value).alias("percentile"))


def findings_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """SHA-1 over the sorted rows of a small findings table: changes when any finding does."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("hash"))
