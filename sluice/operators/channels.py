"""Channels: price modes, provider limits, probe series, override operations, retention and prompt rules."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.traffic import field, items, kind

OPERATION = "struct<op:string,path:string,value:string>"


# --- prices -----------------------------------------------------------------------------------------------------------
def price_cost(mode: Column, units: Column, flat_fee: Column, per_million: Column, tiers: Column) -> Column:
    """Cost of units (tokens) in a price mode; prices are per million units, tiers (up_to, price) ascend, the last is open.

    flat_fee: the fee. usage_per_unit: one price. usage_tiered: each tier's share at its price. usage_volume: all units at
    the price of the tier they reach. Other modes: null."""
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("from"))
    top = lambda t: F.coalesce(t["up_to"].cast("double"), F.lit(float("inf")))
    share = lambda s, t: F.greatest(F.lit(0.0), F.least(units.cast("double"), top(t)) - s["from"])
    tiered = F.aggregate(tiers, start, lambda s, t: F.struct((s["cost"] + share(s, t) * t["price"]).alias("cost"), top(t).alias("from")), lambda s: s["cost"])
    reached = F.get(F.filter(tiers, lambda t: units.cast("double") <= top(t)), 0)["price"]
    return F.when(mode == "flat_fee", flat_fee).when(mode == "usage_per_unit", units * per_million / 1e6).when(mode == "usage_tiered", tiered / 1e6).when(mode == "usage_volume", units * reached / 1e6)


# --- provider limits --------------------------------------------------------------------------------------------------
def quota_limits(quota: Column) -> Column:
    """Typed limits of a provider's quota JSON (its _limits); entries that aren't objects are left out."""
    text = lambda e, name: F.when(kind(field(e, name)) == "text", field(e, name, "string"))
    filled = lambda e, name: F.nullif(text(e, name), F.lit(""))
    number = lambda e, name: F.when(kind(field(e, name)) == "other", field(e, name, "double"))
    row = lambda e: F.struct(
        F.coalesce(text(e, "type"), F.lit("")).alias("type"), F.coalesce(text(e, "status"), F.lit("unknown")).alias("status"), F.coalesce(number(e, "usageRatio"), F.lit(0.0)).alias("usage_ratio"),
        F.coalesce((F.schema_of_variant(field(e, "ready")) == "BOOLEAN") & field(e, "ready", "boolean"), F.lit(False)).alias("ready"), filled(e, "window").alias("window"),
        F.try_to_timestamp(filled(e, "periodStart")).alias("period_start"), F.try_to_timestamp(filled(e, "nextResetAt")).alias("next_reset_at"),
    )
    return F.transform(F.filter(items(field(F.try_parse_json(quota), "_limits")), lambda e: F.schema_of_variant(e).startswith("OBJECT")), row)


def window_pressure(limits: Column, now: Column) -> Column:
    """Whether some running window's use is ahead of its time; spent ones and those without a period don't count."""
    s = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    bounded = lambda x: ~F.coalesce(x["window"], F.lit("")).isin("pay_as_you_go", "credits") & (x["status"] != "exhausted")
    running = lambda x: (x["period_start"] < now) & (x["next_reset_at"] > now)
    ahead = lambda x: x["usage_ratio"] > F.try_divide(s(now) - s(x["period_start"]), s(x["next_reset_at"]) - s(x["period_start"]))
    return F.coalesce(F.exists(limits, lambda x: F.coalesce(bounded(x) & running(x) & ahead(x), F.lit(False))), F.lit(False))


def battery_level(used_percent: Column, status: Column) -> Column:
    left = 100 - used_percent
    return F.when(status == "exhausted", "warning").when(left < 5, "empty").when(left < 20, "low").when(left < 80, "medium").otherwise("full")


# Where providers state how much is used, and the factor that makes it percent.
USED_AT = {
    "claudecode": (("windows.5h.utilization", "windows.7d.utilization"), 100.0),
    "codex": (("rate_limit.primary_window.used_percent",), 1.0),
    "xai_subscription": (("billing.weekly.usage_percent", "billing.monthly.usage_percent"), 1.0),
    "nanogpt": (("windows.weeklyInputTokens.percentUsed", "windows.dailyInputTokens.percentUsed", "windows.dailyImages.percentUsed"), 100.0),
    "opencode_go": (("windows.rolling.usage_percent", "windows.weekly.usage_percent", "windows.monthly.usage_percent"), 1.0),
}


def used_percent(provider: Column, quota: Column, used_at: dict = USED_AT) -> Column:
    """The largest share used that a provider's quota JSON states; 0 where it states none or the provider isn't known."""
    v = F.try_parse_json(quota)
    at = lambda path: F.coalesce(F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), "double"), F.lit(0.0))
    out = F.lit(0.0)
    for name, (paths, factor) in used_at.items():
        most = F.greatest(*map(at, paths)) if len(paths) > 1 else at(paths[0])
        out = F.when(provider == name, most * factor).otherwise(out)
    return out


# The words of a quota's detail line.
DETAIL = {"used": "用量", "reset": "重置", "window": "主窗口用量", "plan": "套餐", "next": "下次重置", "apart": "；"}


def _minutes(t: Column) -> Column:
    """An ISO time up to its minutes; shorter texts as they are."""
    return F.when(F.length(t) >= 16, F.concat(F.replace(F.substring(t, 1, 16), F.lit("T"), F.lit(" ")), F.lit("Z"))).otherwise(t)


def _stated(v: Column, path: str) -> Column:
    """A value as text; null where it is absent, null, empty, zero or false."""
    text = field(v, path, "string")
    return F.when(~text.isin("", "false") & ~F.coalesce(field(v, path, "double") == 0, F.lit(False)), text)


def _whole_percent(share: Column) -> Column:
    """Halves go to the even percent."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def _detail_line(v: Column, words: dict[str, str]) -> Column:
    data = field(v, "quotaData")
    objects = lambda path: F.filter(items(field(data, path)), lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    reset = lambda e, path: F.coalesce(F.concat(F.lit(f"，{words['reset']} "), _minutes(_stated(e, path))), F.lit(""))
    show = lambda e, path: F.coalesce(field(e, path, "string"), F.lit("-"))
    number = lambda e, path: F.when(~kind(field(e, path)).isin("text", "tree"), field(e, path, "double"))
    full = lambda e: F.coalesce(_whole_percent(F.try_divide(number(e, "used"), number(e, "limit"))), F.lit("-"))
    rows = F.transform(objects("rows"), lambda e: F.concat(show(e, "label"), F.lit(" "), show(e, "used"), F.lit("/"), show(e, "limit"), F.lit("（"), full(e), F.lit("）"), reset(e, "resetAt")))
    limits = F.transform(objects("_limits"), lambda e: F.concat(show(e, "type"), F.lit(f" {words['used']} "), _whole_percent(field(e, "usageRatio", "double")), reset(e, "nextResetAt")))
    window = F.concat(F.lit(f"{words['window']} "), field(data, "rate_limit.primary_window.used_percent", "string"), F.lit("%"))
    plan = F.concat(F.lit(f"{words['plan']} "), _stated(data, "plan_type"))
    other = F.array_compact(F.concat(limits, F.array(window, plan)))
    after = F.array_compact(F.array(F.concat(F.lit(f"{words['next']} "), _minutes(_stated(v, "nextResetAt")))))
    parts = F.when(F.size(items(field(data, "rows"))) > 0, rows).when(F.size(other) > 0, other).otherwise(after)
    return F.coalesce(F.array_join(parts, words["apart"]), F.lit(""))


def quota_detail(status: Column, words: dict[str, str] = DETAIL) -> Column:
    """A line that tells what a provider's quota status (JSON) says: its rows, else its limits, main window and plan, else when
    it is reset next; empty if it says nothing. Malformed entries are left out and fail nothing."""
    return F.transform(F.array(F.try_parse_json(status)), lambda v: _detail_line(v, words))[0]  # parsed once


# --- series and previews ----------------------------------------------------------------------------------------------
def probe_series(rows: DataFrame, channel: str, at: str, ok: Column, tps: str, ttft: str, every: str = "1 day") -> DataFrame:
    """(channel, points): per channel and span of time all and successful requests and mean speeds, in order of time."""
    per = rows.groupBy(channel, F.window(at, every)["start"].alias("start")).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.avg(tps).alias("tokens_per_second"), F.avg(ttft).alias("ttft_ms"))
    return per.groupBy(channel).agg(F.array_sort(F.collect_list(F.struct("start", "total", "success", "tokens_per_second", "ttft_ms"))).alias("points"))


def retention_preview(tables: dict[str, tuple[DataFrame, str, int]], now: Column) -> DataFrame:
    """(resource, retention_days, cutoff, estimated_count): how many rows of each resource are older than it keeps them;
    tables gives rows, their time column and the days kept."""
    out = None
    for name, (rows, at, days) in tables.items():
        cutoff = now - F.expr(f"INTERVAL {int(days)} DAYS")
        one = rows.agg(F.count_if(F.col(at) < cutoff).alias("estimated_count")).select(F.lit(name).alias("resource"), F.lit(days).alias("retention_days"), cutoff.alias("cutoff"), "estimated_count")
        out = one if out is None else out.unionByName(one)
    return out


# --- override operations ----------------------------------------------------------------------------------------------
def merged_headers(existing: Column, template: Column) -> Column:
    """Header operations: a template's set takes the place of those of the same path, case aside; all else is kept."""
    path = lambda o: F.when((o["op"] == "set") & (o["path"] != ""), F.lower(o["path"]))
    taken = F.array_compact(F.transform(template, path))
    return F.concat(F.filter(existing, lambda o: ~F.coalesce(F.array_contains(taken, path(o)), F.lit(False))), template)


def merged_operations(existing: Column, template: Column) -> Column:
    """Body operations: a template's set, set_if_absent and delete stand where the first such one of their path stood."""
    path = lambda o: F.when(o["op"].isin("set", "set_if_absent", "delete"), o["path"])
    old, new = F.transform(existing, path), F.transform(template, path)
    has = lambda paths, p: F.coalesce(F.array_contains(paths, p), F.lit(False))
    same = lambda p: F.filter(template, lambda t: F.coalesce(path(t) == p, F.lit(False)))
    none = F.array().cast(f"array<{OPERATION}>")
    stand = F.transform(existing, lambda o, i: F.when(~has(new, path(o)), F.array(o)).when(F.array_position(old, path(o)) == i + 1, same(path(o))).otherwise(none))
    return F.concat(F.flatten(stand), F.filter(template, lambda t: ~has(old, path(t))))


def _overlaid(a, b):
    return {**a, **{k: _overlaid(a.get(k), x) for k, x in b.items()}} if isinstance(a, dict) and isinstance(b, dict) else b


def merged_parameters(existing: Column, template: Column) -> Column:
    """Two JSON objects as one, nested objects merged, the template's values first; the template where either isn't one."""

    def one(a: str | None, b: str | None) -> str | None:
        try:
            x, y = json.loads(a or "{}"), json.loads(b or "{}")
        except (ValueError, RecursionError):
            return b
        return json.dumps(_overlaid(x, y), ensure_ascii=False, separators=(",", ":")) if isinstance(x, dict) and isinstance(y, dict) else b

    def merged(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=object)

    return F.pandas_udf(merged, "string")(existing, template)


# --- prompt rules -----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class PromptRule:
    pattern: str
    action: str
    replacement: str = ""
    scopes: tuple[str, ...] = ()
    enabled: bool = True


def prompt_preview(text: Column, rules: list[PromptRule], scope: str | None = None) -> Column:
    """struct(result, matched, rejected): the text after the mask rules, in order, and whether a rule, or a reject rule,
    fits. Rules without scopes hold for all. A replacement is plain text."""
    result, matched, rejected = text, F.lit(False), F.lit(False)
    for r in rules:
        if r.enabled and (not r.scopes or scope is None or scope in r.scopes):
            hit = F.coalesce(result.rlike(r.pattern), F.lit(False))
            matched = matched | hit
            if r.action == "mask":
                result = F.regexp_replace(result, r.pattern, r.replacement.replace("\\", "\\\\").replace("$", "\\$"))
            else:
                rejected = rejected | hit
    return F.struct(result.alias("result"), matched.alias("matched"), rejected.alias("rejected"))


# --- key profiles -----------------------------------------------------------------------------------------------------
def profile_of_template(name: Column, profile: Column) -> Column:
    """The profile that a key template (JSON) sets: no mappings and the match mode "any" where it has none, a monthly
    calendar period unless it names another kind, costs as text, and every other field null where it is missing. Text that
    isn't a JSON object gives the defaults alone."""
    v = F.try_parse_json(profile)
    texts = lambda path: field(v, path, "array<string>")
    period = F.coalesce(field(v, "quota.period.type", "string"), F.lit("calendar_duration"))
    month = F.when(period == "calendar_duration", F.struct(F.lit("month").alias("unit")))
    return F.struct(
        name.alias("name"), items(field(v, "modelMappings")).alias("modelMappings"), texts("channelIDs").alias("channelIDs"), texts("channelTags").alias("channelTags"),
        F.coalesce(F.nullif(field(v, "channelTagsMatchMode", "string"), F.lit("")), F.lit("any")).alias("channelTagsMatchMode"), texts("modelIDs").alias("modelIDs"), field(v, "loadBalanceStrategy", "string").alias("loadBalanceStrategy"),
        F.struct(
            field(v, "quota.requests", "long").alias("requests"), field(v, "quota.totalTokens", "long").alias("totalTokens"), field(v, "quota.cost", "string").alias("cost"),
            F.struct(period.alias("type"), field(v, "quota.period.pastDuration", "struct<value:long,unit:string>").alias("pastDuration"), F.coalesce(field(v, "quota.period.calendarDuration", "struct<unit:string>"), month).alias("calendarDuration")).alias("period"),
        ).alias("quota"),
    )
