"""The registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import cross_tokenizer, html_extraction, importance_resampling, jaccard_join, mixing, nearest_neighbours, packing, quality_classifier, quality_rules, spot_fingerprints, substring_dedup, token_counts, toxicity
from sluice.llm._common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_quality(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text", "source"), tokenizer_path("word_bpe_49k.json"), weights=mixing.WEIGHTS)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.merge_passages(substring_dedup.repeated_passages(read(spark, sf_dir, "documents", "doc_id", "text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_extraction.extract_pages(pages, html_extraction.learn_weights(pages))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_classifier.score_quality(docs, model).withColumn("held_out", held_out())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance_resampling.resample(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_fingerprints.compare_neighbours(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.cross_align(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_host_quality, op2_pack, op3_repeated_passages, op4_toxicity, op5_jaccard_join, op6_main_text, op7_quality_classifier, op8_token_counts, op9_nearest_neighbours, op10_mix_sources, op11_importance_resampling, op12_spot_fingerprints, op13_cross_tokenizer)}

_OP1 = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
base AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counts),
failed AS (SELECT source, unnest([{'rule': 'short', 'f': n_words < 50}, {'rule': 'repetitive', 'f': 100 * n_repeat_words > 50 * n_words}, {'rule': 'symbols', 'f': 10 * n_symbols > n_words}, {'rule': 'lines', 'f': n_dup_lines > 3}]) AS x FROM base),
hosts AS (SELECT source, x.rule AS rule, count(*) AS n, count(*) FILTER (WHERE x.f) AS f FROM failed GROUP BY 1, 2),
mv AS (SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v FROM hosts GROUP BY 1),
prior AS (SELECT rule, m, CASE WHEN v > 1e-12 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM mv),
rates AS (SELECT source, rule, n, s, m, (f + m * s) / (n + s) AS r FROM hosts JOIN prior USING (rule)),
verdicts AS (SELECT source, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (WHERE r - 2.0 * sqrt(r * (1 - r) / (n + s + 1)) > least(2 * m + 0.1, (1 + m) / 2)), '') AS host_rules FROM rates GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_rules = '') AS kept, host_rules
FROM base JOIN verdicts ON base.source IS NOT DISTINCT FROM verdicts.source
"""

_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: CRC-32 of a feature's bytes: a step's table entry is the sum, without carries, of the entries of its byte's bits.
_OP11 = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT k, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM w),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
crc AS (SELECT f, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b:
  xor(c >> 8, xor(xor(xor((xor(c, b) & 1) * 1996959894, ((xor(c, b) >> 1) & 1) * 3993919788), xor(((xor(c, b) >> 2) & 1) * 124634137, ((xor(c, b) >> 3) & 1) * 249268274)),
    xor(xor(((xor(c, b) >> 4) & 1) * 498536548, ((xor(c, b) >> 5) & 1) * 997073096), xor(((xor(c, b) >> 6) & 1) * 1994146192, ((xor(c, b) >> 7) & 1) * 3988292384)))), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM hexed),
fb AS (SELECT k, bucket FROM f JOIN crc ON f.f = crc.f),
counts AS (SELECT bucket, count(*) FILTER (WHERE doc_id IS NOT NULL) AS s, count(*) FILTER (WHERE doc_id IS NULL) AS t FROM fb JOIN w USING (k) GROUP BY bucket),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts, whole),
per AS (SELECT k, CAST(count(*) AS BIGINT) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM fb JOIN gains USING (bucket) GROUP BY k),
scored AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN per USING (k) WHERE doc_id IS NOT NULL),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN r <= (SELECT 25 * count(*) // 100 FROM ranked) THEN r END AS BIGINT) AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
nx AS (SELECT doc_id, t, lead(doc_id) OVER w AS next_id, lead(t) OVER w AS next_t, first_value(doc_id) OVER w AS top_id, first_value(t) OVER w AS top_t FROM d WINDOW w AS (ORDER BY doc_id DESC)),
ed AS (SELECT doc_id, t, coalesce(next_id, top_id) AS next_id, left(t, length(t) - length(t) // 2) || left(coalesce(next_t, top_t), length(t) // 2) AS e FROM nx),
texts AS (SELECT doc_id, 0 AS kind, t FROM ed UNION ALL SELECT doc_id, 1, e FROM ed),
ws AS (SELECT doc_id, kind, t, regexp_extract_all(lower(t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
r AS (SELECT doc_id, kind, i, ws[i] AS w, list_contains(ANCHORS, ws[i]) AS common FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM ws)),
c AS (SELECT *, sum(CASE WHEN common THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY i) AS c FROM r),
content AS (SELECT doc_id, kind, c AS n, w FROM c WHERE NOT common),
spots AS (SELECT doc_id, kind, '^' AS a, 0 AS c FROM texts UNION ALL SELECT doc_id, kind, w, c FROM c WHERE common),
chains AS (SELECT s.doc_id, s.kind, a || ' ' || x.w || coalesce(' ' || y.w, '') AS g FROM spots s JOIN content x ON x.doc_id = s.doc_id AND x.kind = s.kind AND x.n = s.c + 1 LEFT JOIN content y ON y.doc_id = s.doc_id AND y.kind = s.kind AND y.n = s.c + 2
  UNION ALL SELECT doc_id, kind, CASE WHEN len(ws) = 0 THEN '!' || t ELSE ' ^ ' || array_to_string(ws, ' ') END FROM ws ANTI JOIN content USING (doc_id, kind) WHERE t <> ''),
fp AS (SELECT doc_id, kind, list(s ORDER BY s) AS sigs FROM (SELECT DISTINCT doc_id, kind, substr(md5(g), 1, 10) AS s FROM chains) GROUP BY doc_id, kind),
sets AS (SELECT doc_id, kind, coalesce(sigs, []) AS sigs FROM texts LEFT JOIN fp USING (doc_id, kind)),
pairs AS (SELECT ed.doc_id, t, e, a.sigs AS a, b.sigs AS b, n.sigs AS n FROM ed JOIN sets a ON a.doc_id = ed.doc_id AND a.kind = 0 JOIN sets b ON b.doc_id = ed.doc_id AND b.kind = 1 JOIN sets n ON n.doc_id = ed.next_id AND n.kind = 0),
shared AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, n)) AS an FROM pairs)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, base64(unhex(array_to_string(a, ''))) AS fingerprint, base64(unhex(array_to_string(b, ''))) AS edited_fingerprint,
  CASE WHEN a = b THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 OR least(len(a), len(b)) < FLOOR::DOUBLE * greatest(len(a), len(b)) THEN 0.0 ELSE ab::DOUBLE / (len(a) + len(b) - ab) END AS near_edited,
  CASE WHEN a = n THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(n) = 0 OR least(len(a), len(n)) < FLOOR::DOUBLE * greatest(len(a), len(n)) THEN 0.0 ELSE an::DOUBLE / (len(a) + len(n) - an) END AS near_next,
  CAST(len(a) AS BIGINT) AS n_signatures FROM shared
""".replace("ANCHORS", str(list(spot_fingerprints.ANCHORS))).replace("FLOOR", str(spot_fingerprints.FLOOR))

#: The other operators learn, hash, search approximately or use a tokenizer: tested against brute force instead.
ORACLE_SQL: dict[str, str] = {"op1_host_quality": _OP1, "op5_jaccard_join": _OP5, "op11_importance_resampling": _OP11, "op12_spot_fingerprints": _OP12}
