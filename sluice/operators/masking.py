"""Spans and masking. Offsets of regex matches don't exist in Spark, so spans are found in Arrow batches; merging and
applying spans are array expressions."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import rules as R
from sluice.functions import text as X

SPAN = "array<struct<start:int,end:int,replacement:string,entity:string>>"
#: What may stand between digits, dropped by normalization; and characters that are several signs in compatibility form.
_BETWEEN = r"[\s\p{Z}_\-\x{200B}-\x{200D}\x{FEFF}\x{FE33}\x{FE34}\x{FE4D}-\x{FE4F}\x{FE63}\x{FF0D}\x{FF3F}]"
_COMPOUND = r"[\p{No}\p{Nl}\x{3200}-\x{33FF}]"
#: Parts that pass something to or from a tool, and where they hold it.
CARRIERS = {"tool_use": "input", "tool_result": "content"}


def mask_text(text: str | None, rules: list[R.FormatRule], fold: dict[str, str], compiled: list | None = None, all_found: bool = False) -> tuple[str | None, list[str]]:
    """Masks what mask rules find in the normalized text, the latest start first; a span that reaches into one already
    masked is skipped. Returns the text and the entities in the order of masking; with ``all_found`` also those of skipped
    spans, as of a number that is both a card's and an identity's."""
    if not text:
        return text, []
    norm, at = X.hard_normalize_text(text, fold)
    found = [(at[m.start()], at[m.end() - 1] + 1, r) for r, ps in compiled or compile_rules(rules) for p in ps for m in p.finditer(norm) if m.end() > m.start()]
    bound, entities = len(text) + 1, []
    for start, end, r in sorted(found, key=lambda s: -s[0]):
        entity, free = r.entity or r.code or "PII", end <= bound
        if free:
            text = text[:start] + (r.replacement or f"【PII:{entity}】") + text[end:]
            bound = start
        if free or all_found:
            entities.append(entity)
    return text, entities


def compile_rules(rules: list[R.FormatRule]) -> list[tuple[R.FormatRule, list[re.Pattern]]]:
    """Enabled mask rules; patterns that don't compile are left out."""
    out = []
    for r in rules:
        if r.enabled and r.action == "mask":
            ok = []
            for p in r.norm:
                try:
                    ok.append(re.compile(p))
                except re.error:
                    continue
            out.append((r, ok))
    return out


def masked(df: DataFrame, text: str, rules: list[R.FormatRule] = R.FORMAT_RULES, fold: dict[str, str] | None = None, only_digits: bool = True, all_found: bool = False, apart: bool = True) -> DataFrame:
    """Adds masked_text and entities, as mask_text gives them. Rows without a run of 11 digits (separators aside) can't match the default rules and
    skip Python; with ``only_digits`` off every row goes. These are two branches over ``df``; with ``apart`` off all rows go in one,
    for a ``df`` that costs more to compute twice."""
    table = X.folding(fold)
    may = F.col(text).rlike(rf"(?U)(?:\d{_BETWEEN}*){{11}}|{_COMPOUND}") if only_digits else F.lit(True)
    may = F.coalesce(may, F.lit(False))
    place, width = df.columns.index(text), len(df.columns)
    no = df.withColumn("masked_text", F.col(text)).withColumn("entities", F.array().cast("array<string>"))

    def run(batches):
        compiled = compile_rules(rules)
        for b in batches:
            tried = b.column(width).to_pylist() if b.num_columns > width else [True] * b.num_rows
            rows = [mask_text(t, rules, table, compiled, all_found) if x else (t, []) for t, x in zip(b.column(place).to_pylist(), tried, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=[*b.schema.names[:width], "masked_text", "entities"])

    if not apart:
        return df.withColumn("_sluice_may", may).mapInArrow(run, no.schema)
    return no.where(~may).unionByName(df.where(may).mapInArrow(run, no.schema))


def longest_apart(spans: list[tuple[int, int]]) -> list[int]:
    """Numbers of the spans (start, end) that stay, by their start: longest first, the earlier start at ties, those that overlap
    a kept one dropped. Kept spans are disjoint, so a span is held only against the two beside it."""
    starts, kept = [], []
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0] - spans[k][1], spans[k][0])):
        start, end = spans[k]
        at = bisect.bisect_left(starts, start)
        if (at == 0 or spans[kept[at - 1]][1] <= start) and (at == len(kept) or end <= starts[at]):
            starts.insert(at, start)
            kept.insert(at, k)
    return kept


def recognizer_spans(df: DataFrame, text: str, recognizers: list[R.Recognizer] = R.RECOGNIZERS, out: str = "spans", merged: bool = False) -> DataFrame:
    """Adds all spans of the recognizers, in code points; merged: those that merge_spans keeps, latest start first."""
    place = df.columns.index(text)

    def run(batches):
        known = [(r, re.compile(r.regex)) for r in recognizers]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string()), ("entity", pa.string())]))
        for b in batches:
            spans = [[{"start": m.start(), "end": m.end(), "replacement": r.replacement, "entity": r.entity} for r, p in known for m in p.finditer(t or "")] for t in b.column(place).to_pylist()]
            if merged:
                spans = [[x[k] for k in reversed(longest_apart([(s["start"], s["end"]) for s in x]))] for x in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, out])

    schema = df.withColumn(out, F.lit(None).cast(SPAN)).schema
    return df.mapInArrow(run, schema)


def external_spans(text: Column, answer: Column, labels: dict[str, tuple[str, str]] | None = None) -> Column:
    """Spans that an external recognizer reported as JSON, {"spans": [{"label", "start", "end"}]}, in code points: those of known
    labels within the text. What isn't such an answer gives none, so that the text passes."""
    known = labels or R.EXTERNAL_LABELS
    names = F.create_map(*[x for k, (entity, replacement) in known.items() for x in (F.lit(k), F.struct(F.lit(replacement).alias("replacement"), F.lit(entity).alias("entity")))])
    got = F.from_json(answer, "struct<spans:array<struct<label:string,start:int,end:int>>>")["spans"]
    fits = lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & F.map_contains_key(names, F.coalesce(s["label"], F.lit(""))), F.lit(False))
    made = lambda s: X.let(F.try_element_at(names, s["label"]), lambda n: F.struct(s["start"].alias("start"), s["end"].alias("end"), n["replacement"].alias("replacement"), n["entity"].alias("entity")))
    return F.coalesce(F.transform(F.filter(got, fits), made), F.array().cast(SPAN)).cast(SPAN)


def merge_spans(spans: Column) -> Column:
    """Longest first, the earlier start at ties, those that overlap a kept one dropped; latest start first."""
    order = F.array_sort(spans, lambda a, b: F.when(a["end"] - a["start"] != b["end"] - b["start"], (b["end"] - b["start"]) - (a["end"] - a["start"])).otherwise(a["start"] - b["start"]))
    free = lambda kept, s: ~F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
    kept = F.aggregate(order, F.array().cast(SPAN), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    return F.array_sort(kept, lambda a, b: b["start"] - a["start"])


def apply_spans(text: Column, spans: Column) -> Column:
    """Replaces spans given latest start first."""
    return F.aggregate(spans, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["replacement"], F.substring(t, s["end"] + 1, F.length(t))))


def entities_of(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity"])))


# --- messages ---------------------------------------------------------------------------------------------------------
def recognized_text(text: str, known: list[tuple[R.Recognizer, re.Pattern]]) -> tuple[str, list[str]]:
    """Masks what recognizers find; where spans overlap the longest stays, the earlier at ties."""
    found = [(m.start(), m.end(), r) for r, p in known for m in p.finditer(text)]
    kept = [found[k] for k in longest_apart([(start, end) for start, end, _ in found])]
    for start, end, r in reversed(kept):
        text = text[:start] + r.replacement + text[end:]
    return text, [r.entity for *_, r in kept]


def map_strings(value, fn: Callable[[str], str]):
    """A JSON value with fn applied to its strings, however deep; keys stay."""
    if isinstance(value, str):
        return fn(value)
    if isinstance(value, list):
        return [map_strings(x, fn) for x in value]
    return {k: map_strings(x, fn) for k, x in value.items()} if isinstance(value, dict) else value


def map_message(message, fn: Callable[[str], str]):
    """A chat message with fn applied to its content, its parts' texts and the strings of its tool carriers."""
    if not isinstance(message, dict):
        return message

    def call(c):
        held = c.get("function") if isinstance(c, dict) else None
        return c | {"function": held | {"arguments": map_strings(held["arguments"], fn)}} if isinstance(held, dict) and "arguments" in held else c

    def part(p):
        if not isinstance(p, dict):
            return p
        at = CARRIERS.get(p["type"]) if isinstance(p.get("type"), str) else None
        new = {at: map_strings(p[at], fn)} if at in p else {}
        return p | new | ({"text": fn(p["text"])} if isinstance(p.get("text"), str) else {})

    change = {"tool_calls": lambda v: [call(c) for c in v] if isinstance(v, list) else v, "content": lambda v: fn(v) if isinstance(v, str) else [part(p) for p in v] if isinstance(v, list) else v}
    return {k: change[k](v) if k in change else v for k, v in message.items()}


def masked_messages(df: DataFrame, messages: str, rules: list[R.FormatRule] = R.FORMAT_RULES, recognizers: list[R.Recognizer] = R.RECOGNIZERS, fold: dict[str, str] | None = None, only_digits: bool = True) -> DataFrame:
    """Adds masked_messages and entities (sorted) to rows of chat messages, a JSON array as text.

    The rules mask first; only where they find nothing in any message the recognizers do. Either list may be empty. Rows
    in which nothing is found keep their text; what isn't a JSON array is masked as one text; null stays null. Rows that
    can't hold 11 digits skip Python, as in ``masked``."""
    table = X.folding(fold)
    may = F.col(messages).rlike(rf"(?U)(?:\d(?:{_BETWEEN}|\\[nrt])*){{11}}|{_COMPOUND}|\\u") if only_digits else F.col(messages).isNotNull()
    may = F.coalesce(may, F.lit(False))
    place = df.columns.index(messages)
    no = df.where(~may).withColumn("masked_messages", F.col(messages)).withColumn("entities", F.array().cast("array<string>"))

    def parsed(text: str):
        try:
            v = json.loads(text)
        except (ValueError, RecursionError):
            return None
        return v if isinstance(v, list) else None

    def written(value) -> str:
        out = json.dumps(value, ensure_ascii=False)
        return out if out.isascii() or not re.search("[\ud800-\udfff]", out) else json.dumps(value)

    def run(batches):
        compiled, known = compile_rules(rules), [(r, re.compile(r.regex)) for r in recognizers]
        layers = [lambda t: mask_text(t, rules, table, compiled)] * bool(rules) + [lambda t: recognized_text(t, known)] * bool(recognizers)

        def mask(text):
            value = parsed(text)
            for layer in layers:
                found: set[str] = set()

                def one(t, layer=layer, found=found):
                    new, entities = layer(t)
                    found.update(entities)
                    return new

                new = one(text) if value is None else [map_message(m, one) for m in value]
                if found:
                    return new if value is None else written(new), sorted(found)
            return text, []

        for b in batches:
            rows = [mask(t) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=[*b.schema.names, "masked_messages", "entities"])

    return no.unionByName(df.where(may).mapInArrow(run, no.schema))
