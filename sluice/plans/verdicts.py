"""The layered verdict on texts as one projection: block, mask or pass, with the reasons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import rules as R
from sluice.functions import text as X
from sluice.operators import detect, masking


@dataclass(frozen=True)
class Layers:
    """Which detectors run; one that is off costs nothing, for its expressions aren't built."""

    secrets: bool = True
    terms: bool = True
    fingerprints: bool = True
    injection: bool = True
    rules: list[R.FormatRule] = field(default_factory=lambda: R.FORMAT_RULES)
    term_list: list[R.Term] = field(default_factory=list)
    min_hits: int = 2


def verdicts(docs: DataFrame, id_col: str, text: str, layers: Layers, store: DataFrame | None = None, bypass: DataFrame | None = None) -> DataFrame:
    """id, action, rule_ids, groups, masked_text, entities (all that rules find, where spans overlap too).

    Order: secrets and terms, directly and in decoded payloads; protected fingerprints; injection groups; masking. A text
    blocked by an earlier layer isn't judged by a later one. bypass: (id, layers) of texts whose listed layers are off."""
    df = docs.select(F.col(id_col), F.col(text).alias("_t"))
    df = df.join(bypass.select(F.col(id_col), F.col("layers").alias("_off")), id_col, "left") if bypass is not None else df.withColumn("_off", F.lit(None).cast("array<string>"))
    on = lambda name: ~F.coalesce(F.array_contains("_off", name) | F.array_contains("_off", "all"), F.lit(False))
    none = F.array().cast("array<string>")
    df = X.with_hard_normalized(df, "_t", "_n")
    terms = {t.value: t.rule_id for t in layers.term_list}

    def direct(raw, norm):
        codes = [F.when(on("l1"), detect.secret_codes(raw, norm, layers.rules)).otherwise(none)] if layers.secrets else []
        if layers.terms and terms:
            ids = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
            codes.append(F.when(on("l2"), F.transform(detect.term_hits(F.lower(norm), F.lower(raw), layers.term_list), lambda t: F.element_at(ids, t))).otherwise(none))
        return F.array_sort(F.array_distinct(F.concat(*codes))) if codes else none

    df = df.withColumn("_pre", direct(F.col("_t"), F.col("_n")))
    encoded = F.col("_t").rlike("[A-Za-z0-9+/]{16,}|[0-9a-fA-F]{24,}")
    hidden = F.when((F.size("_pre") == 0) & encoded, X.decoded_texts(F.col("_t"))).otherwise(none)
    # decoded payloads are matched raw and with separators dropped
    squeezed = lambda t: F.translate(t, R.SEPARATORS + R.ZERO_WIDTH, "")
    found = F.flatten(F.transform(hidden, lambda t: X.let(squeezed(t), lambda n: direct(t, n))))
    df = df.withColumn("_pre", F.when(F.size("_pre") > 0, F.col("_pre")).otherwise(F.array_sort(F.array_distinct(found))))
    if layers.fingerprints and store is not None:
        still_open = F.when((F.size("_pre") == 0) & on("edm"), F.col("_t"))  # blocked texts aren't probed
        df = detect.with_fingerprint_hits(df.select(id_col, "_t", "_off", "_pre"), still_open, store)
        df = df.withColumn("_pre", F.when(F.greatest("shingle_hits", "line_hits") >= layers.min_hits, F.array(F.lit("edm.fingerprint"))).otherwise(F.col("_pre")))
    groups = F.when((F.size("_pre") == 0) & on("rules"), detect.injection_match(F.col("_t"))["groups"]).otherwise(none) if layers.injection else none
    df = df.withColumn("groups", F.coalesce(groups, none))
    df = masking.masked(df.select(id_col, "_t", "_pre", "groups"), "_t", layers.rules, all_found=True, apart=False)  # in one branch: all layers are above it
    action = F.when(F.size("_pre") > 0, "block").when(F.size("groups") > 0, "block").when(F.size("entities") > 0, "mask").otherwise("pass")
    return df.select(id_col, action.alias("action"), F.col("_pre").alias("rule_ids"), "groups", F.when(action == "block", F.lit(None)).otherwise(F.col("masked_text")).alias("masked_text"), F.array_sort(F.array_distinct("entities")).alias("entities"))
