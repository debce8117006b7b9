"""Model cards: which to create, link, enable or leave to a person, from the channels that offer a model.

One row per action. Cards are never rewritten where that could lose something: links of another kind than channel and model,
conditions nested deeper than they are read, archived cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import text as X
from sluice.operators.traffic import field, items

# How a link of a channel's model is written, and the levels of a condition that are read.
LINK_TYPE = "channel_model"
CONDITION_LEVELS = 4
LINK = "array<struct<type:string,priority:long,disabled:boolean,channel_id:long,model_id:string,when:string>>"


def channel_number(gid: Column) -> Column:
    """The number after the last slash of a global id; null of any other text."""
    return F.regexp_extract(gid, r"/([^/]*)$", 1).try_cast("long")


def too_deep(condition: Column, level: int = 1) -> Column:
    """Whether a condition (a variant) has conditions on its last level that is read, so that deeper ones may be missing."""
    below = items(field(condition, "conditions"))
    return F.exists(below, lambda c: F.schema_of_variant(c).startswith("OBJECT") if level == CONDITION_LEVELS else too_deep(c, level + 1))


def _linked_channel(a: Column) -> Column:
    """The channel of a link of a channel's model; null of links of another kind or shape."""
    kind = F.lower(F.replace(F.coalesce(field(a, "type", "string"), F.lit("")), F.lit("_"), F.lit("")))
    return F.when((kind == "channelmodel") & field(a, "channelModel.modelId", "string").isNotNull(), field(a, "channelModel.channelId", "long"))


def _links(associations: Column) -> Column:
    """Links of a card as structs; ``channel_id`` is null for those of another kind or shape. ``deep``: see too_deep."""

    def one(a: Column) -> Column:
        return F.struct(
            field(a, "type", "string").alias("type"), F.coalesce(field(a, "priority", "long"), F.lit(0)).cast("long").alias("priority"), F.coalesce(field(a, "disabled", "boolean"), F.lit(False)).alias("disabled"),
            _linked_channel(a).alias("channel_id"), field(a, "channelModel.modelId", "string").alias("model_id"), F.to_json(field(a, "when")).alias("when"), F.coalesce(too_deep(field(a, "when.condition")), F.lit(False)).alias("deep"),
        )

    return F.transform(items(associations), one)


def wanted_links(offers: DataFrame) -> DataFrame:
    """From offers (model, channel_gid, channel_name, status), one a channel and model: model, offered (channel_id, name) of
    enabled channels by channel_id, and off, the names of the others. Channels without a number are left out."""
    rows = offers.select("model", channel_number(F.col("channel_gid")).alias("channel_id"), F.coalesce("channel_name", "channel_gid").alias("name"), F.coalesce(F.col("status") == "enabled", F.lit(False)).alias("on"))
    per = rows.where("channel_id is not null and model is not null").groupBy("model", "channel_id", "on").agg(F.min("name").alias("name"))
    lists = per.groupBy("model").agg(F.array_sort(F.collect_list(F.when(F.col("on"), F.struct("channel_id", "name")))).alias("offered"), F.collect_set(F.when(~F.col("on"), F.col("name"))).alias("off"))
    return lists.withColumn("off", F.array_sort("off"))


def card_actions(offers: DataFrame, cards: DataFrame, channels: DataFrame) -> DataFrame:
    """(kind, model, card_id, enable, reason, added, names, links) for each card that needs something.

    offers: as for wanted_links; cards: (card_id, model, status, settings), one a model, settings a variant; channels:
    (channel_gid, status), the state of all channels.

    create: no card; with links to the enabled channels, enabled if there is one. attach: links are missing or written in another
    way (reason 'type'); links holds all, old ones as they are but for the type, and enable says whether a disabled card that got
    links is enabled. skip: not rewritten because it is 'archived', holds 'foreign' links or 'deep' conditions. enable: a
    disabled card that needs no links and has one to an enabled channel; without channels none is enabled."""
    live = channels.where(F.col("status") == "enabled").select(channel_number(F.col("channel_gid")).alias("channel_id")).where("channel_id is not null").distinct()
    have = cards.select("card_id", "model", "status", _links(field(F.col("settings"), "associations")).alias("have"))
    idle = cards.where("status = 'disabled'").select("card_id", F.transform(items(field(F.col("settings"), "associations")), _linked_channel).alias("to"))
    reached = idle.select("card_id", F.explode("to").alias("channel_id")).join(live, "channel_id", "left_semi").select("card_id").distinct()
    have = have.join(reached.withColumn("reached", F.lit(True)), "card_id", "left")
    rows = wanted_links(offers).withColumn("is_wanted", F.lit(True)).join(have, "model", "full")

    def facts(ours: Column) -> Column:
        held = F.transform(F.filter(ours, lambda a: a["model_id"] == F.col("model")), lambda a: a["channel_id"])
        missing = X.let(F.coalesce(held, F.array().cast("array<long>")), lambda h: F.filter("offered", lambda o: F.col("card_id").isNull() | ~F.array_contains(h, o["channel_id"])))
        retype = F.coalesce(F.exists(ours, lambda a: ~F.coalesce(a["type"] == LINK_TYPE, F.lit(False))), F.lit(False))
        return F.struct(missing.alias("missing"), retype.alias("retype"), F.exists("have", lambda a: a["channel_id"].isNull()).alias("foreign"), F.exists(ours, lambda a: a["deep"]).alias("deep"))

    def judged(f: Column) -> Column:
        work = F.col("is_wanted") & ((F.size(f["missing"]) > 0) | f["retype"])
        reason = F.when(F.col("status") == "archived", "archived").when(work & f["foreign"], "foreign").when(work & f["deep"], "deep")
        kind = (
            F.when(F.col("card_id").isNull(), "create")
            .when(F.col("is_wanted") & reason.isNotNull(), "skip")
            .when(work, "attach")
            .when((F.col("status") == "disabled") & F.col("reached"), "enable")
        )
        return F.struct(kind.alias("kind"), reason.alias("reason"), f["missing"].alias("missing"), f["retype"].alias("retype"))

    # exploded, since a filter on the kind would compare all links again
    found = X.let(X.let(F.filter("have", lambda a: a["channel_id"].isNotNull()), facts), judged)
    rows = rows.select("model", "card_id", "status", "offered", "off", "have", F.explode(F.filter(F.array(found), lambda x: x["kind"].isNotNull())).alias("x")).select("*", "x.*")
    made = F.col("kind").isin("create", "attach")
    new = F.transform("missing", lambda o: F.struct(F.lit(LINK_TYPE).alias("type"), F.lit(0).cast("long").alias("priority"), F.lit(False).alias("disabled"), o["channel_id"].alias("channel_id"), F.col("model").alias("model_id"), F.lit(None).cast("string").alias("when")))
    old = F.transform("have", lambda a: F.struct(F.lit(LINK_TYPE).alias("type"), *[a[c].alias(c) for c in ("priority", "disabled", "channel_id", "model_id", "when")]))
    enable = F.when(F.col("kind") == "create", F.size("offered") > 0).when(F.col("kind") == "attach", (F.size("missing") > 0) & ~F.coalesce(F.col("status") == "enabled", F.lit(False))).otherwise(F.col("kind") == "enable")
    return rows.select(
        "kind", "model", "card_id", enable.alias("enable"),
        F.when(F.col("kind") == "skip", F.col("reason")).when((F.col("kind") == "attach") & F.col("retype"), "type").alias("reason"),
        F.when(made, F.transform("missing", lambda o: o["channel_id"])).alias("added"),
        F.when((F.col("kind") == "create") & (F.size("offered") == 0), F.col("off")).when(made, F.transform("missing", lambda o: o["name"])).alias("names"),
        F.when(made, F.concat(F.coalesce(old, F.array().cast(LINK)), new)).alias("links"),
    )
