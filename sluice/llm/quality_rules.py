"""Operator 1: host-level quality rules.

Each document gets its counts and fails or passes each rule of RULES. Failures are summed by host and rule. For each rule
the hosts' own rates give a beta prior (method of moments); a host's rate is shrunk towards its mean, and the host is
rejected when its posterior lies above the rule's limit: mean - Z standard deviations of the posterior over
min(2 m + 0.1, (1 + m) / 2), m the prior's mean. Few documents, or a rate that is usual among hosts, never reject one.
Verdicts are joined back: documents of a rejected host go, whatever they are like themselves.

Defined results: a null text counts as empty; a null host is a host of its own; repeated rows count each.
An empty table gives an empty result. Columns besides the three inputs are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import join_bounded, map_arrow, stage

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Standard deviations of its posterior by which a host must pass a limit.
Z = 2.0
_METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated three-word windows."""
    import numpy as np

    words = text.split()  # bytes.split() cuts at exactly the six ASCII white-space characters
    n = len(words)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    chars = sum(len(w) for w in words)
    if not text.isascii():
        raw = np.frombuffer(text, np.uint8)
        chars -= int(np.count_nonzero((raw & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if n > 3 and len(ids) < n:
        k = len(ids)
        pair = codes[:-1] * k + codes[1:]
        if k > 2_000_000:  # k**3 would pass 2**63
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * k + codes[2:]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = count[inverse] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= hit
        covered[1:-1] |= hit
        covered[2:] |= hit
        repeat = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row per document: id, host and the five counts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(b):
        texts = b.column(2).cast(pa.binary()).to_pylist()
        counts = [text_counts(t or b"") for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True))], names=["id", "host", *(x.split()[0] for x in _METRICS.split(", "))])

    src = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(src, run, f"id {id_type}, host string, {_METRICS}")


def rules(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> dict[str, Column]:
    """Rules by name, true where a document fails. The first two are the base verdict's."""
    return {
        "short": F.col("n_words") < min_words,
        "repetitive": 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": F.col("n_dup_lines") > 3,
    }


def host_rates(counts: DataFrame, failed: dict[str, Column], z: float = Z) -> DataFrame:
    """One row per host and rule: documents, failures, shrunk rate, limit, and whether the rule rejects the host.

    With rates p_i of a rule over hosts, mean m and variance v (each host weighs the same), the prior is
    Beta(m s, (1 - m) s) with s = m (1 - m) / v - 1, held to 1..1000 (1000 where v is 0)."""
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"_{r}") for r, c in failed.items()])
    per = hosts.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("f")) for r in failed])).alias("x")).select("host", "n", "x.rule", "x.f")
    per = stage(per, "host-rules")
    m, v, n, f, s = (F.col(c) for c in "mvnfs")
    prior = per.groupBy("rule").agg(F.avg(f / n).alias("m"), F.var_pop(f / n).alias("v"))
    prior = prior.select("rule", "m", F.when(v > 1e-12, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(1000.0).alias("s"))
    rate = (f + m * s) / (n + s)
    low = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + s + 1))
    limit = F.least(2 * m + 0.1, (1 + m) / 2)
    rows = per.join(F.broadcast(prior), "rule").withColumn("rate", rate)  # one row a rule
    return rows.select("host", "rule", F.col("n").alias("host_docs"), F.col("f").alias("host_failed"), "rate", limit.alias("limit"), (low > limit).alias("rejects"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, z: float = Z) -> DataFrame:
    """Counts, base verdict, final verdict and the rules that reject the host (comma-separated) of every document."""
    failed = rules(min_words, max_repeat_percent)
    counts = stage(document_counts(docs, id_col, text_col, host_col), "rules")
    key = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("h")
    hosts = host_rates(counts, failed, z).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("rejects"), F.col("rule")))), ",").alias("host_rules"))
    rows = join_bounded(counts.select("*", key), stage(hosts, "hosts"), ["h"])
    base = failed["short"] | failed["repetitive"]
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.col("host_rules") == "")).alias("kept"), "host_rules")
