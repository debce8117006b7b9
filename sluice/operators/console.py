"""The console's side of the service: keys and their tiers, requests for them, bypass entries, snapshots, routing inputs and
short texts for cards. Everything is a column expression or a DataFrame operation over the entities' tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import rules as R
from sluice.functions import text as X

# Tiers by rank, words that name them, the layers that an entry may switch off, a stand-in for no profile.
TIERS = {"体验档": 0, "标准档": 1, "高档": 2}
TIER_WORDS = [("高档", ("premium", "pro"), "高档"), ("标准", ("standard", "std"), "标准档")]
LAYERS = ("l1", "l2", "edm", "rules", "pg", "judge", "response")
NO_PROFILE = "__no_profile__"
TOKEN = "[A-Za-z0-9+/]{16,}={0,2}"


# --- texts before they are scored ---------------------------------------------------------------------------------------
def pre_decoded(text: Column) -> Column:
    """Each base64-like token that decodes to printable text is replaced by it wherever it stands, in the order of matches;
    what comes out isn't decoded again."""
    plain = lambda t: F.when(F.length(t) % 4 == 0, F.try_validate_utf8(F.try_to_binary(t, F.lit("base64")).cast("string")))

    def put(acc: Column, t: Column) -> Column:
        return X.let(plain(t), lambda s: F.when(F.coalesce(X.printable(s), F.lit(False)), F.replace(acc, t, s)).otherwise(acc))

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), text, put)


def with_scoring_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text as scorers get it: zero-width characters out, compatibility form of the whole, then pre_decoded. Plain Latin
    rows stay in the JVM."""
    bare = df.withColumn(out, F.translate(text, R.ZERO_WIDTH, ""))
    latin = F.coalesce(F.col(out).rlike(r"^[\x00-\x7F\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}]*$"), F.lit(True))

    def run(batches):
        import unicodedata

        for b in batches:
            at = b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in b.column(at).to_pylist()], pa.string())], names=b.schema.names)

    both = bare.where(latin).unionByName(bare.where(~latin).mapInArrow(run, bare.schema))
    return both.withColumn(out, pre_decoded(F.col(out)))


# --- judges' answers ----------------------------------------------------------------------------------------------------
def _answer(reply: Column) -> Column:
    """The JSON object of a model's reply, without its code fence, as a variant; null for what is none."""
    fenced = lambda r: F.regexp_replace(F.regexp_replace(F.trim(r), "^(```json|```)", ""), "```$", "")
    bare = X.let(reply, lambda r: F.when(F.contains(r, F.lit("```")), fenced(r)).otherwise(r))
    return X.let(F.try_parse_json(F.trim(bare)), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def _sure(v: Column) -> Column:
    """Its confidence, 0 if absent; null, for the whole answer, if it is no number."""
    return X.let(F.try_variant_get(v, "$.confidence", "string"), lambda raw: F.when(raw.isNull() | (raw == ""), 0.0).otherwise(raw.try_cast("double")))


def _truth(v: Column, path: str) -> Column:
    """Whether a value is true, a number but 0 or a text that isn't empty."""
    t = F.try_variant_get(v, path, "string")
    return F.coalesce(~t.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def _judged(reply: Column, fields) -> Column:
    """struct of fields(answer, confidence); null without a usable answer. A reply is parsed once however many fields are read."""
    return X.let(_answer(reply), lambda v: X.let(_sure(v), lambda c: F.when(v.isNotNull() & c.isNotNull(), F.struct(*fields(v, c)))))


def judged_text(reply: Column) -> Column:
    """struct(confidential, entities, confidence) of a judge's reply; null where it has no usable one, which lets a text pass."""
    entities = lambda v: F.coalesce(F.try_variant_get(v, "$.entities", "array<string>"), F.array().cast("array<string>"))
    return _judged(reply, lambda v, c: (_truth(v, "$.confidential").alias("confidential"), entities(v).alias("entities"), c.alias("confidence")))


def judged_injection(reply: Column) -> Column:
    """struct(injection, confidence, attack_type), as judged_text."""
    kind = lambda v: F.coalesce(F.try_variant_get(v, "$.attack_type", "string"), F.lit(""))
    return _judged(reply, lambda v, c: (_truth(v, "$.injection").alias("injection"), c.alias("confidence"), kind(v).alias("attack_type")))


def known_gaps(vectors: DataFrame) -> DataFrame:
    """Test rows that are documented to slip through the rules, to be tried on a judge instead: they pass, with a note, and aren't
    negatives."""
    slips = (F.col("expect") == "pass") & (F.coalesce("note", F.lit("")) != "") & ~F.coalesce(F.col("layer") == "negative", F.lit(False))
    return vectors.where(slips).select("name", "content", F.lit("confidential").alias("expect"))


# --- routing inputs -----------------------------------------------------------------------------------------------------
def session_key(header: Column, metadata: Column, messages: Column) -> Column:
    """h: and the header's id, else m: and the metadata's, else u: and the SHA-256 of the first user message with text, else null.

    messages: array<struct<role, content string, parts array<struct<type, text>>>>; a message's text is its content, or its
    parts' texts in a row."""
    own = lambda c: F.when(F.trim(c) != "", F.trim(c))
    said = lambda m: F.when(F.coalesce(m["content"], F.lit("")) != "", m["content"]).otherwise(F.array_join(F.transform(m["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    texts = F.filter(F.transform(F.filter(messages, lambda m: m["role"] == "user"), said), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.coalesce(F.concat(F.lit("h:"), own(header)), F.concat(F.lit("m:"), own(metadata)), F.concat(F.lit("u:"), F.sha2(F.try_element_at(texts, F.lit(1)), 256)))


def tool_loop(messages: Column) -> Column:
    """Whether the last message hands over a tool's result or waits for one. messages: as above, with calls (their number)."""
    last = F.try_element_at(messages, F.lit(-1))
    parts = F.exists(F.coalesce(last["parts"], F.array().cast("array<struct<type:string,text:string>>")), lambda p: F.coalesce(p["type"] == "tool_result", F.lit(False)))
    return F.coalesce((last["role"] == "tool"), F.lit(False)) | F.coalesce(last["calls"] > 0, F.lit(False)) | F.coalesce(parts, F.lit(False))


def has_thinking(messages: Column) -> Column:
    """Whether any part is a thinking block."""
    block = lambda m: F.exists(m["parts"], lambda p: p["type"].isin("thinking", "redacted_thinking"))
    return F.coalesce(F.exists(messages, lambda m: F.coalesce(block(m), F.lit(False))), F.lit(False))


# --- keys, tiers and requests for them ----------------------------------------------------------------------------------
def tier_of(text: Column) -> Column:
    """The tier that free text names; the first that fits; null if none."""
    out = F.lit(None).cast("string")
    for word, others, tier in reversed(TIER_WORDS):
        hit = text.contains(word)
        for o in others:
            hit = hit | F.lower(text).contains(o)
        out = F.when(F.coalesce(hit, F.lit(False)), tier).otherwise(out)
    return out


def tier_rank(tier: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), tier)


def upgrade_verdicts(chosen: DataFrame, keys: DataFrame, request: str = "request_id") -> DataFrame:
    """request, verdict (ok, unknown key, no upgrade) of requests to raise keys to a tier.

    chosen: request, user, key, tier; keys: user, key, enabled, current. Every key must be an enabled one of the user; at least
    one must stand below the tier, and a key without a known tier does."""
    mine = keys.where("enabled").select("user", "key", tier_rank(F.col("current")).alias("_rank"), F.lit(True).alias("_mine"))
    rows = chosen.join(mine, ["user", "key"], "left")
    known, done = F.bool_and(F.col("_mine").isNotNull()), F.bool_and(F.coalesce(F.col("_rank") >= tier_rank(F.col("tier")), F.lit(False)))
    return rows.groupBy(request).agg(F.when(~known, "unknown key").when(done, "no upgrade").otherwise("ok").alias("verdict"))


def key_name(open_id: Column, purpose: Column, day: Column, code: Column) -> Column:
    """emp-, 8 characters of the id, day, 12 of the purpose, the code's last 4 in lower case; only letters and digits."""
    only = lambda c, keep="": F.regexp_replace(F.coalesce(c, F.lit("")), rf"[^\p{{L}}\p{{N}}{keep}]", "")
    or_else = lambda c, other: F.when(c == "", other).otherwise(c)
    tail = F.lower(F.right(only(code), F.lit(4)))
    return F.concat(F.lit("emp-"), or_else(F.left(only(open_id, "_"), F.lit(8)), "unknown"), F.lit("-"), day, F.lit("-"), or_else(F.left(only(purpose), F.lit(12)), "key"), F.lit("-"), or_else(tail, "0000"))


def open_id(email: Column, suffix: str = "@casdoor.oidc") -> Column:
    return F.when(F.endswith(email, F.lit(suffix)), F.left(email, F.length(email) - len(suffix)))


def numeric_id(gid: Column) -> Column:
    """The number after a global id's last slash; null if it is none."""
    return F.element_at(F.split(gid, "/"), -1).try_cast("bigint")


def request_list(requests: DataFrame, email: str = "", project: str | None = None, default_project: str = "default") -> DataFrame:
    """Newest first, optionally of one applicant and one project; requests without a project belong to the default one."""
    df = requests.where(F.col("email") == email) if email else requests
    df = df.where(F.coalesce(F.when(F.col("project") != "", F.col("project")), F.lit(default_project)) == project) if project else df
    return df.orderBy(F.desc("position"))


def tier_keys(keys: DataFrame, project: str | None = None, user: str | None = None, profile: str | None = None) -> DataFrame:
    """Keys of a project, user and active profile, NO_PROFILE for those without one; what isn't given doesn't filter."""
    for column, value in (("project", project), ("user", user)):
        keys = keys.where(F.col(column) == value) if value else keys
    return keys.where(F.coalesce("profile", F.lit("")) == ("" if profile == NO_PROFILE else profile)) if profile else keys


def profiles_in_use(keys: DataFrame) -> DataFrame:
    return keys.select(F.coalesce(F.when(F.col("profile") != "", F.col("profile")), F.lit(NO_PROFILE)).alias("profile")).distinct().orderBy("profile")


def without_project(users: DataFrame, members: DataFrame, project) -> DataFrame:
    """Activated users with an external identity, no owners, who aren't in the project."""
    ready = users.where((F.col("status") == "activated") & ~F.coalesce("owner", F.lit(False)) & (F.coalesce("identities", F.lit(0)) > 0))
    return ready.join(members.where(F.col("project") == project).select("user").distinct(), "user", "left_anti")


def keys_with_usage(keys: DataFrame, usage: DataFrame, key: str = "key_id") -> DataFrame:
    """Every key with its usage entries; null where there are none."""
    return keys.join(usage, key, "left")


def active_entries(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """The usage entry of each key's active profile."""
    return keys.where(F.coalesce("profile", F.lit("")) != "").join(entries.withColumnRenamed("entry_profile", "profile"), ["key_id", "profile"])


# --- bypass entries -----------------------------------------------------------------------------------------------------
def _entry_error(label: Column, scope: Column, layers: Column) -> Column:
    known = F.forall(layers, lambda x: x.isin(*LAYERS))
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", "no label").when(F.length(label) > 64, "label too long").when(~F.coalesce(scope.isin("all", "layers"), F.lit(False)), "unknown scope").when((scope == "layers") & (F.coalesce(F.size(layers), F.lit(0)) <= 0), "no layers").when((scope == "layers") & ~known, "unknown layer")


def _entry_layers(scope: Column, layers: Column) -> Column:
    return F.when(scope == "layers", F.array_sort(F.array_distinct(layers))).otherwise(F.array().cast("array<string>"))


def add_bypass(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list with new entries (token, label, scope, layers, added_by, added_at), and the rejected tokens with reasons.

    Only the token's SHA-256 is kept; known tokens and repeated ones but the first are rejected."""
    rows = new.withColumn("id", F.when(F.coalesce("token", F.lit("")) != "", F.sha2("token", 256)))
    rows = rows.join(entries.select("id", F.lit(True).alias("_known")), "id", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("added_at", "label")))
    error = F.when(F.col("id").isNull(), "no token").otherwise(F.coalesce(_entry_error(F.col("label"), F.col("scope"), F.col("layers")), F.when(F.col("_known") | (F.col("_nth") > 1), "known token")))
    rows = rows.withColumn("error", error)
    good = rows.where("error is null").select("id", F.trim("label").alias("label"), "scope", _entry_layers(F.col("scope"), F.col("layers")).alias("layers"), F.lit(True).alias("enabled"), F.coalesce("added_by", F.lit("")).alias("added_by"), "added_at")
    return entries.unionByName(good), rows.where("error is not null").select("token", "error")


def update_bypass(entries: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list with changes (one a id; null fields keep what is there), and the ids that are unknown or whose change is invalid."""
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in ("label", "scope", "layers", "enabled")], F.lit(True).alias("_change"))
    new = {x: F.coalesce(f"_{x}", x) for x in ("label", "scope", "layers", "enabled")}
    rows = entries.join(c, "id", "left").withColumn("_error", F.when(F.col("_change"), _entry_error(new["label"], new["scope"], new["layers"])))
    ok = F.col("_error").isNull() & F.coalesce("_change", F.lit(False))
    out = rows.select("id", F.when(ok, F.trim(new["label"])).otherwise(F.col("label")).alias("label"), F.when(ok, new["scope"]).otherwise(F.col("scope")).alias("scope"), F.when(ok, _entry_layers(new["scope"], new["layers"])).otherwise(F.col("layers")).alias("layers"), F.when(ok, new["enabled"]).otherwise(F.col("enabled")).alias("enabled"), "added_by", "added_at")
    unknown = changes.join(entries.select("id"), "id", "left_anti").select("id", F.lit("unknown id").alias("error"))
    return out, rows.where("_error is not null").select("id", F.col("_error").alias("error")).unionByName(unknown)


def remove_bypass(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The list without some ids; ids that it doesn't hold change nothing."""
    return entries.join(ids.select("id").distinct(), "id", "left_anti")


def audit_rows(changes: DataFrame) -> DataFrame:
    """Log rows of configuration changes: who (e-mail, else id, else unknown), what, and which paths; never values."""
    who = F.coalesce(F.when(F.col("email") != "", F.col("email")), F.when(F.col("user_id").cast("string") != "", F.col("user_id").cast("string")), F.lit("unknown"))
    return changes.select("ts", F.lit("admin").alias("layer"), who.alias("actor"), "op", F.array_sort("paths").alias("changed"))


def usage_percent(used: Column, limit: Column) -> Column:
    """Percent of a limit; null without a positive one."""
    return F.when(limit > 0, used * 100.0 / limit)


def percent_text(pct: Column) -> Column:
    """Whole percent; <1% for what rounds to nothing but isn't."""
    return F.when(pct.isNull(), F.lit(None)).when((pct > 0) & (pct < 1), "<1%").otherwise(F.concat(F.floor(pct + 0.5).cast("string"), F.lit("%")))


def head_tier(probabilities: Column, hard: list[str], threshold: float = 0.5) -> Column:
    """struct(p, tier) of a local classifier: the sum of the probabilities of the hard categories. probabilities: map<string, double>."""
    p = F.aggregate(F.filter(F.map_entries(probabilities), lambda e: e["key"].isin(hard)), F.lit(0.0), lambda a, e: a + F.coalesce(e["value"], F.lit(0.0)))
    return X.let(p, lambda x: F.struct(x.alias("p"), F.when(x >= threshold, "complex").otherwise("simple").alias("tier")))


# --- numbers and short texts --------------------------------------------------------------------------------------------
def token_count_text(n: Column, chinese: bool) -> Column:
    """A count in 万 and 亿, or K, M and B, to one place."""
    out = n.cast("string")
    for least, unit in ((1e4, "万"), (1e8, "亿")) if chinese else ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(n >= least, F.concat(_whole(n / least), F.lit(unit))).otherwise(out)
    return out


def _whole(x: Column) -> Column:
    t = (F.floor(x * 10 + 0.5) / 10).cast("decimal(38,1)").cast("string")
    return F.regexp_replace(t, r"\.0$", "")


def credits_text(cost: Column) -> Column:
    t = (F.floor(cost * 100 + 0.5) / 100).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(t, "0$", ""), r"\.0?$", "")


def cache_hit_rate(cached: Column, inputs: Column) -> Column:
    """Percent to one place; 0 without input."""
    return F.when(inputs > 0, F.round(100.0 * cached / inputs, 1)).otherwise(0.0)


def safe_number(x: Column) -> Column:
    """A number, or 0 for what is none, missing or not finite."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def success_card(total: Column, failed: Column) -> Column:
    """Percent of requests that didn't fail, as text to one place; 0.0 without requests."""
    return F.when(total > 0, F.format_string("%.1f", (total - failed) * 100.0 / total)).otherwise("0.0")


def short_time(ts: Column) -> Column:
    """Date and minute of an ISO time with Z; shorter texts stay."""
    t = F.coalesce(ts, F.lit(""))
    return F.when(F.length(t) >= 16, F.concat(F.replace(F.left(t, F.lit(16)), F.lit("T"), F.lit(" ")), F.lit("Z"))).otherwise(t)


def self_window(now: str, window: str, offset_minutes: int = 0) -> Column | None:
    """Start of the day or month of ``now`` (UTC) where local time is UTC less the offset, in UTC; None for all time."""
    if abs(offset_minutes) > 840:
        raise ValueError("offset beyond 14 hours")
    if window == "all":
        return None
    shift = F.expr(f"INTERVAL {offset_minutes} MINUTES")
    local = F.lit(now).cast("timestamp_ntz") - shift
    return (F.date_trunc(window, local).cast("timestamp_ntz") + shift).cast("timestamp_ntz")


def day_range(start: str | None, end: str | None, start_time: str = "00:00:00", end_time: str = "23:59:59") -> tuple[str | None, str | None]:
    """Bounds of a range of days, the end's last millisecond included; parts of a time are held to their range, what can't be
    read is the default."""

    def clamp(text: str, default: str) -> str:
        parts = []
        for i, most in enumerate((23, 59, 59)):
            given = text.split(":")
            v = given[i] if i < len(given) and re.fullmatch(r"-?\d+", given[i].strip()) else default.split(":")[i]
            parts.append(f"{max(0, min(most, int(v))):02d}")
        return ":".join(parts)

    return start and f"{start} {clamp(start_time, '00:00:00')}.000", end and f"{end} {clamp(end_time, '23:59:59')}.999"


def capped_lines(lines: DataFrame, line: str, order: str, most: int = 12) -> DataFrame:
    """One text of the first lines and how many more there are."""
    first = lines.orderBy(order).limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), "\n").alias("_t"))
    n = lines.agg(F.count(F.lit(1)).alias("_n"))
    more = F.when(F.col("_n") > most, F.concat(F.lit("\n... "), (F.col("_n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return first.join(F.broadcast(n), F.lit(True)).select(F.concat("_t", more).alias("text"))


# --- tables and snapshots -----------------------------------------------------------------------------------------------
def usage_by_user(usage: DataFrame, keys: DataFrame, search: str = "") -> DataFrame:
    """Requests, tokens and cost by user, of those whose name holds ``search`` in any case. usage is summed by key first."""
    per = usage.groupBy("key_id").agg(F.count_distinct("request_id").alias("r"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("t"), F.sum("cost").alias("c"))
    who = keys.where(F.contains(F.lower("user_name"), F.lit(search.lower()))) if search else keys
    return per.join(who, "key_id").groupBy("user_name").agg(F.sum("r").alias("requests"), F.sum("t").alias("total_tokens"), F.sum("c").cast("double").alias("total_cost"))


def page(df: DataFrame, by: str, tie: str, descending: bool = True, number: int = 1, size: int = 10) -> DataFrame:
    """One page of a table in the order of any of its columns; nulls last."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(order, tie).offset((number - 1) * size).limit(size)


def channel_counts(channels: DataFrame) -> DataFrame:
    """type, channels and how many have an error."""
    return channels.groupBy("type").agg(F.count(F.lit(1)).alias("channels"), F.count("error_message").alias("errors"))


def distinct_tags(channels: DataFrame) -> DataFrame:
    return channels.select(F.explode("tags").alias("tag")).distinct()


def trace_usage(usage: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Tokens by kind, with cached ones that were read and written, and cost of every trace."""
    t = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return usage.groupBy(trace).agg(t("input_tokens"), t("output_tokens"), (F.coalesce(F.sum("input_tokens"), F.lit(0)) + F.coalesce(F.sum("output_tokens"), F.lit(0))).cast("long").alias("total_tokens"), t("cached_tokens"), t("written_tokens"), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"))


def request_filter(requests: DataFrame, statuses: list | None = None, sources: list | None = None, model: str = "", traced: DataFrame | None = None) -> DataFrame:
    """Requests of some statuses and sources, whose model's name holds a text in any case, and that have a trace; what isn't given
    doesn't filter."""
    for column, values in (("status", statuses), ("source", sources)):
        requests = requests.where(F.col(column).isin(list(values))) if values else requests
    requests = requests.where(F.contains(F.lower("model"), F.lit(model.lower()))) if model else requests
    return requests.join(traced.select("request_id"), "request_id", "left_semi") if traced is not None else requests


def in_thread(requests: DataFrame, traces: DataFrame, thread) -> DataFrame:
    """Requests that have a trace of a thread."""
    return requests.join(traces.where(F.col("thread_id") == thread).select("request_id"), "request_id", "left_semi")


def resolved_models(associations: DataFrame, models: DataFrame) -> DataFrame:
    """association, channel_id, request_model, actual_model, source of the channels' models that fit an association.

    associations: association, kind, channel_id or null for any, pattern; kind 'model' fits the name, 'regex' the whole name.
    models: channel_id, request_model, actual_model, source. Names and channels join by equality; patterns, a small table of
    rules, are tried on the distinct names."""
    exact = associations.where("kind = 'model'").alias("a").join(models.alias("m"), F.col("a.pattern") == F.col("m.request_model"))
    names = models.select("request_model").distinct()
    rules = associations.where("kind = 'regex'")
    fits = names.join(F.broadcast(rules), F.expr("request_model rlike concat('^(?:', pattern, ')$')")) if rules.count() <= 10_000 else names.join(rules, F.expr("request_model rlike concat('^(?:', pattern, ')$')"))
    loose = fits.select("association", "channel_id", F.col("request_model").alias("pattern")).alias("a").join(models.alias("m"), F.col("a.pattern") == F.col("m.request_model"))
    pick = [F.col("a.association").alias("association"), *(F.col(f"m.{c}").alias(c) for c in ("channel_id", "request_model", "actual_model", "source"))]
    on = F.col("a.channel_id").isNull() | (F.col("a.channel_id") == F.col("m.channel_id"))
    return exact.where(on).select(*pick).unionByName(loose.where(on).select(*pick)).distinct()


def snapshot_health(channels: DataFrame, min_attempts: int = 5, min_success: float = 90.0) -> DataFrame:
    """One row: channels, available ones, the failure rate by attempts over measured channels, and anomalies and failing
    channels as text, the worst first. channels: name, disabled, attempts, success_pct (null if not measured)."""
    measured = (F.col("attempts") > 0) & F.col("success_pct").isNotNull()
    odd = F.col("disabled") | ((F.col("attempts") >= min_attempts) & F.coalesce(F.col("success_pct") < min_success, F.lit(False)))
    failing = measured & (F.col("success_pct") < 100)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["name"]), ",")
    rate = F.try_divide(F.sum(F.when(failing, F.col("attempts") * (100 - F.col("success_pct"))).otherwise(0.0)), F.sum(F.when(measured, F.col("attempts"))))
    return channels.agg(
        F.count(F.lit(1)).alias("channels"), F.count_if(~F.col("disabled")).alias("available"), F.round(rate, 6).alias("failure_rate"),
        text(F.when(odd, F.struct(F.lit(0).alias("o"), F.col("name").alias("name")))).alias("anomalies"), text(F.when(failing, F.struct(F.col("success_pct").alias("o"), F.col("name").alias("name")))).alias("failing"),
    )


def snapshot_top(rows: DataFrame, name: str, value: str, most: int = 3) -> DataFrame:
    """The rows of the largest values, missing ones last."""
    return rows.orderBy(F.desc_nulls_last(value), name).limit(most)


def stale(as_of: Column, now: Column, minutes: int = 20) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp")) >= minutes * 60_000_000
