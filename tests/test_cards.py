"""Card actions, quota lines and times at an offset on small hand-made rows."""

import json

from pyspark.sql import functions as F

from sluice.functions import text as X
from sluice.operators import cards
from sluice.operators import channels as C

OFFER = "model string, channel_gid string, channel_name string, status string"
CARD = "card_id string, model string, status string, settings string"


def link(channel, model, kind="channel_model", **more):
    return {"type": kind, "channelModel": {"channelId": channel, "modelId": model}, **more}


def nested(levels):
    return {"condition": {"conditions": [{"field": "x"}] if levels == 1 else [nested(levels - 1)["condition"]]}}


def actions(spark, offers, have, channels=()):
    have = [(i, m, s, None if a is None else json.dumps({"associations": a})) for i, m, s, a in have]
    df = spark.createDataFrame(have, CARD).withColumn("settings", F.try_parse_json("settings"))
    got = cards.card_actions(spark.createDataFrame(offers, OFFER), df, spark.createDataFrame(list(channels), "channel_gid string, status string"))
    return {r.model: r for r in got.collect()}


def test_cards_are_created_linked_and_skipped(spark):
    on = lambda m, c: (m, f"gid://Channel/{c}", f"c{c}", "enabled")
    offers = [on("new", 2), on("new", 1), on("new", 1), ("off", "gid://Channel/9", "c9", "disabled"), ("odd", "junk", "c", "enabled"), ("odd", "gid://Channel/x", "c", "enabled"), (None, "gid://Channel/1", "c", "enabled")]
    offers += [on(m, 1) for m in ("full", "part", "old", "foreign", "deep", "edge", "gone", "bare", "null")] + [on("part", 3)]
    have = [
        ("a", "full", "disabled", [link(1, "full")]), ("b", "part", "disabled", [link(1, "part", priority=4, disabled=True, when=nested(2))]),
        ("c", "old", "disabled", [link(1, "old", "channelModel")]), ("d", "foreign", "enabled", [{"type": "regex"}]), ("e", "deep", "enabled", [link(7, "deep", when=nested(4))]),
        ("f", "edge", "enabled", [link(7, "edge", when=nested(3))]), ("g", "gone", "archived", []), ("h", "bare", "enabled", "junk"), ("i", "null", "enabled", None),
    ]
    got = actions(spark, offers, have)
    assert set(got) == {"new", "off", "part", "old", "foreign", "deep", "edge", "gone", "bare", "null"}
    assert got["new"].kind == "create" and got["new"].enable and got["new"].added == [1, 2] and got["new"].names == ["c1", "c2"] and [x.model_id for x in got["new"].links] == ["new", "new"]
    assert (got["off"].kind, got["off"].enable, got["off"].names, got["off"].links) == ("create", False, ["c9"], [])
    part = got["part"]
    assert (part.kind, part.enable, part.reason, part.added) == ("attach", True, None, [3])
    assert [(x.type, x.channel_id, x.priority, x.disabled) for x in part.links] == [("channel_model", 1, 4, True), ("channel_model", 3, 0, False)] and json.loads(part.links[0].when) == nested(2)
    assert (got["old"].kind, got["old"].enable, got["old"].reason, got["old"].added, got["old"].links[0].type) == ("attach", False, "type", [], "channel_model")
    assert [(got[m].kind, got[m].reason, got[m].links) for m in ("foreign", "deep", "gone")] == [("skip", "foreign", None), ("skip", "deep", None), ("skip", "archived", None)]
    assert [got[m].kind for m in ("edge", "bare", "null")] == ["attach"] * 3


def test_disabled_cards_with_a_live_channel_are_enabled(spark):
    have = [("a", "x", "disabled", [link(1, "x")]), ("b", "y", "disabled", [link(2, "y")]), ("c", "z", "archived", [link(1, "z")]), ("d", "w", "disabled", []), ("e", "v", "enabled", [link(1, "v")])]
    live = [("gid://Channel/1", "enabled"), ("gid://Channel/2", "disabled"), ("junk", "enabled")]
    got = actions(spark, [], have, live)
    assert set(got) == {"x"} and got["x"].kind == "enable" and got["x"].enable and got["x"].links is None
    assert actions(spark, [], have) == {} and actions(spark, [], [], live) == {}


def test_quota_lines(spark):
    rows = [
        {"quotaData": {"rows": [{"label": "w", "used": 1, "limit": 8, "resetAt": "2026-08-26T13:18:57.085269Z"}, 5, {"used": 3}], "_limits": [{"type": "5h", "usageRatio": 0.5}]}},
        {"quotaData": {"_limits": [{"type": "5h", "usageRatio": 0.5, "nextResetAt": "soon"}, {"usageRatio": "much"}, None], "plan_type": "pro", "rate_limit": {"primary_window": {"used_percent": 0}}}},
        {"quotaData": [], "nextResetAt": "2026-08-26T13:18:57Z"}, {"quotaData": {"rows": [3]}, "nextResetAt": "2026-08-26T13:18:57Z"}, {}, "junk", None,
    ]
    df = spark.createDataFrame([(i, r if r is None or r == "junk" else json.dumps(r)) for i, r in enumerate(rows)], "k long, body string")
    got = [r.d for r in df.select("k", C.quota_detail(F.col("body")).alias("d")).orderBy("k").collect()]
    assert got == ["w 1/8（12%），重置 2026-08-26 13:18Z；- 3/-（-）", "5h 用量 50%，重置 soon；主窗口用量 0%；套餐 pro", "下次重置 2026-08-26 13:18Z", "", "", "", ""]


def test_times_at_an_offset(spark):
    df = spark.createDataFrame([(1, "2026-09-02T13:36:45Z"), (2, "2026-09-02T20:00:00+00:00"), (3, "soon"), (4, None), (5, "2026-13-45")], "k long, s string")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = df.select("k", X.iso_zoned(F.col("s")).alias("t"), X.day_key(F.try_to_timestamp("s")).alias("d")).orderBy("k").collect()
            assert [r.t for r in rows] == ["2026-09-02 21:36:45 UTC+8", "2026-09-03 04:00:00 UTC+8", "soon", "", "2026-13-45"]
            assert [r.d for r in rows[:2]] == ["20260902", "20260903"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_links_are_compared_once_a_card(spark):
    """A filter on what an action is would compare all of a card's links again, for each time it is mentioned."""
    df = spark.createDataFrame([("c1", "m1", "disabled", "{}")], "card_id string, model string, status string, settings string").withColumn("settings", F.parse_json("settings"))
    got = cards.card_actions(spark.createDataFrame([("m1", "gid/1", "one", "enabled")], OFFER), df, spark.createDataFrame([("gid/1", "enabled")], "channel_gid string, status string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains(") == 1 and [tuple(x) for x in got.select("kind", "added").collect()] == [("attach", [1])]
