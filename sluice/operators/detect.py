"""Secrets, terms, protected texts and injection patterns: text against small rule tables.

Rules become expressions on the driver, so detectors are projections and add no shuffle. A pattern is only tried on texts
that hold a literal which it requires. Shingles are hashed in Arrow batches, by running sums over a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import rules as R
from sluice.functions import text as X
from sluice.operators import bloom
from sluice.sources.scratch import staged


def _codes(pairs: list[tuple[Column, str]]) -> Column:
    """Sorted distinct codes whose condition holds."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]))))


def secret_codes(raw: Column | None, norm: Column | None, rules: list[R.FormatRule] = R.FORMAT_RULES) -> Column:
    """Codes of enabled reject rules found in the normalized or the raw text; a channel that is None is off."""
    pairs = []
    for r in rules:
        if r.enabled and r.action == "reject" and r.code:
            pairs += [(norm.rlike(p), r.code) for p in r.norm if norm is not None]
            pairs += [(raw.rlike(p), r.code) for p in r.raw if raw is not None]
    return _codes(pairs)


def term_hits(norm_lower: Column, raw_lower: Column, terms: list[R.Term], normalize=lambda s: X.hard_normalize_text(s, X.folding())[0]) -> Column:
    """Values of terms that the normalized text contains, in list order; raw text is tried for terms that aren't plain tokens."""
    found = []
    for t in terms:
        n = normalize(t.value).lower()
        hit = norm_lower.contains(n) if n else F.lit(False)
        plain = all(c.isascii() and c.isalnum() for c in t.value.replace("-", "").replace("_", "")) and t.value
        token = raw_lower.rlike(rf"(?<!\w)\Q{t.value.lower()}\E(?!\w)") if plain else raw_lower.contains(t.value.lower()) if t.value else F.lit(False)
        found.append(F.when(hit | token, F.lit(t.value)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def required(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of a pattern holds one; () if there are none to tell."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    out = []
    for part in [*parts, pattern[start:]]:
        best = _literal(part)
        if not best:
            return ()
        out += best
    return tuple(dict.fromkeys(out))


def _literal(part: str) -> tuple[str, ...]:
    """Of one alternative: the longest run outside groups, or the literals of the group whose shortest is longest."""
    found, run, i = [], "", 0
    while i <= len(part):
        c = part[i : i + 1]
        if c and c not in "\\[](){}.?*+|^$":
            run += c
        else:
            found.append((run[:-1] if c and c in "?*{" else run,))
            run = ""
            if c == "\\":
                i += 1
            elif c == "[":
                i = part.index("]", i + 2)
            elif c == "{":
                i = part.index("}", i)
            elif c == "(":
                end, depth = i, 0
                while True:
                    depth += {"(": 1, ")": -1}.get(part[end], 0)
                    if not depth:
                        break
                    end += 1
                body = part[i + 1 : end]
                if part[end + 1 : end + 2] not in ("?", "*", "{") and not body.startswith(("?!", "?<", "?=")):
                    found.append(required(body.removeprefix("?:")))
                i = end
        i += 1
    return max(found, key=lambda x: min(map(len, x), default=0), default=())


#: Characters without which no literal of the Chinese, Japanese and Korean patterns can stand in a text.
_WIDE = r"[\x{2010}-\x{2027}\x{3000}-\x{9FFF}\x{AC00}-\x{D7A3}]"


def _holds(norm: Column, wide: Column, literals: tuple[str, ...]) -> Column:
    """Whether a text holds one of the literals; those outside ASCII are only looked for in texts with wide characters."""
    plain, other = [x for x in literals if x.isascii()], [x for x in literals if not x.isascii()]
    hit = F.lit(False)
    for x in plain:
        hit = hit | norm.contains(x)
    rest = F.lit(False)
    for x in other:
        rest = rest | norm.contains(x)
    return hit | (wide & rest) if other else hit


def block_excerpts(norm: Column, terms: Column, codes: Column, rules: list[R.FormatRule] = R.FORMAT_RULES, most: int = 5) -> Column:
    """What a block was for: distinct (rule, text), terms first, then of each secret code the first pattern's first match in the
    normalized text, cut for display; ``most`` at most. terms: array<struct<rule, text>> of hits; codes: their sorted codes."""
    kind = "array<struct<rule:string,text:string>>"

    def of(rule: R.FormatRule) -> Column:
        found = [F.when(norm.rlike(p), F.regexp_extract(norm, p, 0)) for p in rule.norm]
        return F.when(F.array_contains(codes, rule.code), F.struct(F.lit(rule.code).alias("rule"), X.excerpt(F.coalesce(*found)).alias("text")))

    secrets = F.array(*[of(r) for r in sorted(rules, key=lambda r: r.code) if r.action == "reject" and r.norm]).cast(kind)
    every = F.concat(F.coalesce(terms.cast(kind), F.array().cast(kind)), F.array_compact(secrets))
    return F.slice(F.array_distinct(F.filter(every, lambda x: F.coalesce(x["text"], F.lit("")) != "")), 1, most)


def near_pattern(n: R.Near) -> str:
    gap = f".{{0,{n.width}}}"
    return f"(?:{n.a}){gap}(?:{n.b})|(?:{n.b}){gap}(?:{n.a})"


def _found(norm: Column, wide: Column, rule: str | R.Near) -> Column:
    """A pattern, tried only on texts that hold what it requires."""
    if isinstance(rule, R.Near):
        return _holds(norm, wide, required(rule.a)) & _holds(norm, wide, required(rule.b)) & norm.rlike(near_pattern(rule))
    needs = required(rule)
    return _holds(norm, wide, needs) & norm.rlike(rule) if needs else norm.rlike(rule)


def injection_groups(norm: Column) -> Column:
    """Sorted groups of injection patterns found in rule-normalized text."""

    def codes(n: Column, wide: Column) -> Column:
        pairs = [(_found(n, wide, p), name) for name, ps in R.INJECTION_GROUPS.items() for p in (ps if isinstance(ps, tuple) else (ps,))]
        family, misfortune, demand = R.EMOTION
        pairs.append((_found(n, wide, family) & _found(n, wide, misfortune) & _found(n, wide, demand), "emotion"))
        leak, masking = R.KEY_EXFIL
        may = _holds(n, wide, required(leak.a)) & _holds(n, wide, required(leak.b))
        pairs.append((may & F.exists(F.regexp_extract_all(n, F.lit(near_pattern(leak)), F.lit(0)), lambda m: ~m.rlike(masking)), "apikey-exfil"))
        return _codes(pairs)

    return X.let(norm, lambda n: X.let(F.coalesce(n.rlike(_WIDE), F.lit(False)), lambda wide: codes(n, wide)))


def injection_match(text: Column) -> Column:
    """struct(hit, groups, depth): groups of the text and, marked with their level, of what it hides in base64."""
    level = lambda texts, d: F.flatten(F.transform(texts, lambda t: F.transform(injection_groups(X.rule_normalize(t)), lambda g: F.concat(g, F.lit(f"@b64L{d}")))))

    def match(first: Column) -> Column:
        pair = F.struct(level(first, 1).alias("one"), level(F.flatten(F.transform(first, lambda t: X.decode_base64(t))), 2).alias("two"))
        return X.let(pair, lambda p: F.struct(F.array_sort(F.array_distinct(F.concat(injection_groups(X.rule_normalize(text)), p["one"], p["two"]))).alias("groups"), F.when(F.size(p["two"]) > 0, 2).when(F.size(p["one"]) > 0, 1).otherwise(0).alias("depth")))

    m = X.let(X.decode_base64(text), match)
    return X.let(m, lambda x: F.struct((F.size(x["groups"]) > 0).alias("hit"), x["groups"].alias("groups"), x["depth"].alias("depth")))


#: Rows whose texts and hashes a task holds as Python objects at a time.
SLICE_ROWS = 500


def sliced(batches):
    """Arrow batches in parts of SLICE_ROWS rows, which share the batch's memory."""
    return (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS))


def _with_hashes(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds struct(s, l): hashes of a text's distinct shingles and long lines."""
    lines = F.transform(X.long_lines(text), lambda x: F.xxhash64(x))
    src = df.withColumns({"_sluice_norm": X.fp_normalize(text), "_sluice_lines": lines})
    kind = pa.struct([("s", pa.list_(pa.int64())), ("l", pa.list_(pa.int64()))])

    def run(batches):
        for b in sliced(batches):
            found = [X.shingle_hashes(t).view(np.int64) for t in b.column(b.num_columns - 2).to_pylist()]
            made = pa.StructArray.from_arrays([pa.array(found, pa.list_(pa.int64())), b.column(b.num_columns - 1).cast(pa.list_(pa.int64()))], fields=[kind.field(0), kind.field(1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], made], names=[*b.schema.names[:-2], out])

    schema = df.withColumn(out, F.lit(None).cast("struct<s:array<bigint>,l:array<bigint>>")).schema
    return src.mapInArrow(run, schema)


def fingerprint_store(corpus: DataFrame, name: str, text: str) -> DataFrame:
    """(doc, kind, fp): distinct shingles (s) and lines (l) of a protected corpus."""
    rows = _with_hashes(corpus.select(F.col(name).alias("doc"), F.col(text).alias("t")).select("doc", "t"), F.col("t"), "x").select("doc", "x")
    kind = lambda k: F.transform(f"x.{k}", lambda v: F.struct(F.lit(k).alias("kind"), v.alias("fp")))
    return rows.select("doc", F.explode(F.concat(kind("s"), kind("l"))).alias("x")).select("doc", "x.kind", "x.fp").distinct()


def with_fingerprint_hits(df: DataFrame, text: Column, store: DataFrame, store_rows: int = 2_000_000) -> DataFrame:
    """Adds shingle_hits and line_hits: a row's distinct shingles and long lines that the store holds (all its documents
    together). A null text has none.

    Tasks try a row's hashes against a Bloom filter of the store. While the store's hashes are within the bound they are
    broadcast too and decide there; beyond it, rows are written once with the few hashes that the filter accepts, which alone
    shuffle to the store, and their counts come back by the row's number."""
    fps = staged(store.select("kind", "fp").distinct(), "fingerprints")
    rows = {r.kind: r["count"] for r in fps.groupBy("kind").count().collect()}  # two kinds
    of = lambda k: fps.where(F.col("kind") == k).select("fp")
    small = sum(rows.values()) <= store_rows
    known = {k: np.sort(of(k).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)) for k in "sl"} if small else None
    filters = {k: bloom.of_array(known[k]) if small else bloom.build(of(k), rows.get(k, 0)) for k in "sl"}
    ctx = df.sparkSession.sparkContext.broadcast((filters, known))
    lines = F.transform(X.long_lines(text), lambda x: F.xxhash64(x))
    src = df.withColumns({"_sluice_norm": X.fp_normalize(text), "_sluice_lines": lines})

    def run(batches):
        filters, known = ctx.value

        def hits(k: str, hashes: np.ndarray) -> np.ndarray:
            found = np.unique(bloom.accepted(filters[k], hashes))
            if known is None or not len(found) or not len(known[k]):
                return found if known is None else found[:0]
            return found[known[k][np.minimum(np.searchsorted(known[k], found), len(known[k]) - 1)] == found]

        for b in sliced(batches):
            s = [hits("s", X.shingle_hashes(t, distinct=False)) for t in b.column(b.num_columns - 2).to_pylist()]
            x = [hits("l", np.array(x or [], np.int64).view(np.uint64)) for x in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array([len(y) for y in part], pa.int64()) if small else pa.array([y.view(np.int64) for y in part], pa.list_(pa.int64())) for part in (s, x)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], names=[*b.schema.names[:-2], "shingle_hits", "line_hits"])

    kind = "bigint" if small else "array<bigint>"
    schema = df.withColumns({c: F.lit(None).cast(kind) for c in ("shingle_hits", "line_hits")}).schema
    out = src.mapInArrow(run, schema)
    if small:
        return out
    held = staged(out.withColumn("_sluice_row", F.monotonically_increasing_id()), "accepted")
    tagged = lambda k, c: F.transform(c, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("fp")))
    asked = held.select("_sluice_row", F.explode(F.concat(tagged("s", "shingle_hits"), tagged("l", "line_hits"))).alias("x")).select("_sluice_row", "x.kind", "x.fp")
    found = asked.join(fps, ["kind", "fp"], "left_semi").groupBy("_sluice_row").agg(*[F.count_if(F.col("kind") == k).alias(f"_sluice_{k}") for k in "sl"])
    return held.join(found, "_sluice_row", "left").select(*df.columns, *[F.coalesce(f"_sluice_{k}", F.lit(0)).cast("long").alias(c) for k, c in (("s", "shingle_hits"), ("l", "line_hits"))])


def fingerprint_matches(docs: DataFrame, store: DataFrame, id_col: str, text: str, min_hits: int = 2, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows sharing min_hits or more distinct shingles, or lines, with the store: id, shingle_hits, line_hits, hits."""
    rows = with_fingerprint_hits(docs.select(F.col(id_col), F.col(text).alias("_t")), F.col("_t"), store, broadcast_rows)
    return rows.select(id_col, "shingle_hits", "line_hits", F.greatest("shingle_hits", "line_hits").alias("hits")).where(F.col("hits") >= min_hits)


def published_matches(docs: DataFrame, store: DataFrame, id_col: str, text: str, min_hits: int = 2) -> DataFrame:
    """fingerprint_matches against a store of SHA-256 fingerprints (kind, fp), as files hold it. Rows' hashes shuffle to it."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.col(text).alias("_t"))
    kind = lambda k, a: F.transform(F.array_distinct(a), lambda x: F.struct(F.lit(k).alias("kind"), X.fingerprint(x).alias("fp")))
    probe = rows.select("_row", id_col, F.explode(F.concat(kind("s", X.shingles(F.col("_t"))), kind("l", X.long_lines(F.col("_t"))))).alias("x")).select("_row", id_col, "x.kind", "x.fp")
    hits = probe.join(store.select("kind", "fp").distinct(), ["kind", "fp"], "left_semi").groupBy("_row", id_col).agg(F.count_if(F.col("kind") == "s").alias("shingle_hits"), F.count_if(F.col("kind") == "l").alias("line_hits"))
    return hits.select(id_col, "shingle_hits", "line_hits", F.greatest("shingle_hits", "line_hits").alias("hits")).where(F.col("hits") >= min_hits)


def store_summary(store: DataFrame) -> DataFrame:
    return store.groupBy("doc").agg(F.count_if(F.col("kind") == "s").alias("shingle_count"), F.count_if(F.col("kind") == "l").alias("line_count"))


def ingest(store: DataFrame, corpus: DataFrame, name: str, text: str) -> DataFrame:
    """The store with the fingerprints of new documents; known names and texts under the shortest line are left out."""
    new = corpus.where(F.length(X.fp_normalize(F.col(text))) >= X.MIN_LINE).join(store.select(F.col("doc").alias(name)).distinct(), name, "left_anti")
    return store.unionByName(fingerprint_store(new, name, text))


def forget(store: DataFrame, names: DataFrame) -> DataFrame:
    """The store without the documents of some names; unknown names change nothing."""
    return store.join(names.select("doc").distinct(), "doc", "left_anti")
