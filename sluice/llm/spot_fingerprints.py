"""Operator 12: document fingerprints from chains of content words after common words (spot signatures).

A text's words are lower-cased runs of letters and digits. Each common word (ANCHORS, and the text's beginning) is a spot:
the next CHAIN content words after it, common ones left out, form its signature. A fingerprint is the set of signatures,
written as sorted five-byte digests. Where words between spots are changed, moved or wrapped in other text, most spots stay.

Two fingerprints are compared by the Jaccard measure of their sets. Sets are partitioned by length: partition k holds sizes
from (1 / floor)**k on, so sets of partitions that aren't neighbours differ by more than 1 / floor in size and their measure
lies below the floor; neither they nor neighbours whose sizes bound it below the floor are intersected, they count as 0.

Everything is DataFrame functions. ``compare_neighbours`` meets each document with the next one in the order of ids
without a task that holds all: ids are cut at quantiles into buckets of some hundred documents, and the first document of a
bucket is also sent, as a guest, to the bucket that ends before it.

Defined results: null is the empty text, whose set is empty; a text whose words are all common is one signature, its words; a
text without words is one, itself. Two empty sets have likeness 1, an empty and another 0. Rows of equal id follow each other
by a hash of their texts; null ids come after all others; one row is its own neighbour; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._common import stage, tune

# Common words of English, French, German and Spanish.
ANCHORS = tuple(
    "the of and to a in is that it for was on with as be by this are at from "
    "de la le et les des un du une que pour est par qui dans en "
    "der die und den von zu das mit sich auf für ist ein eine im dem nicht "
    "el y los se del las por con no su una para es al lo".split()
)
CHAIN = 2
#: Likeness below it isn't computed.
FLOOR = 0.05
#: Documents of a bucket of neighbouring ids, and buckets at most; its logarithm steps find a document's bucket.
BUCKET_DOCS, MAX_BUCKET_BITS = 500, 14
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hexadecimal digits of a signature's digest.
_DIGITS = 10


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct digests of a text's spot signatures. ``text`` must not be null.

    Content words are written after a bar and common ones after a space, so that a split at bars gives, for each content
    word, the common words between it and the next one; all steps are linear in the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"))
    marked = F.concat(F.lit(" ^"), F.array_join(F.transform(words, lambda w: F.when(w.isin(*anchors), F.concat(F.lit(" "), w)).otherwise(F.concat(F.lit("|"), w))), ""))
    return F.transform(F.array(marked), lambda m: _spots(m, text, chain))[0]


def _spots(marked: Column, text: Column, chain: int) -> Column:
    def of(parts: Column) -> Column:
        def follow(part: Column, k: Column) -> Column:
            # element k + 1 is the content word after this part's common words
            content = F.array_join(F.transform(F.slice(parts, k + 2, chain), lambda p: F.substring_index(p, " ", 1)), " ")
            return F.transform(F.array(content), lambda c: F.transform(F.array_distinct(F.slice(F.split(part, " "), 2, 1 << 30)), lambda a: F.concat(a, F.lit(" "), c)))[0]

        found = F.flatten(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), follow))
        whole = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(parts[0] == " ^", F.concat(F.lit("!"), text)).otherwise(parts[0])))
        return F.array_sort(F.array_distinct(F.transform(F.when(F.size(parts) > 1, found).otherwise(whole), lambda s: F.substring(F.md5(s), 1, _DIGITS))))

    return F.transform(F.array(F.split(marked, "\\|")), of)[0]


def fingerprint(sigs: Column) -> Column:
    """The set of signatures as text, without line breaks."""
    return F.translate(F.base64(F.unhex(F.array_join(sigs, ""))), "\r\n", "")


def length_partition(n: Column, floor: float = FLOOR) -> Column:
    """Partition of a set's length; -1 for the empty set."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / math.log(1 / floor))).otherwise(-1)


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard measure of two sets of signatures; 0 where their lengths bound it below the floor."""
    n_a, n_b = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b)).cast("double")
    near = (F.abs(length_partition(n_a, floor) - length_partition(n_b, floor)) <= 1) & (F.least(n_a, n_b) >= floor * F.greatest(n_a, n_b))
    return F.when(a == b, F.lit(1.0)).when((n_a > 0) & (n_b > 0) & near, shared / (n_a + n_b - shared)).otherwise(0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """id, n_signatures, fingerprint of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    rows = tune(docs.sparkSession) and docs.select(F.col(id_col).alias("id"), text).withColumn("s", signatures(F.col("t"), anchors, chain))
    return rows.select(F.col("id").alias(id_col), F.size("s").cast("long").alias("n_signatures"), fingerprint(F.col("s")).alias("fingerprint"))


def _bucket(bounds: list, id_col: Column) -> Column:
    """How many of the sorted bounds an id reaches, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    at = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, k: F.when(F.get(at, lo + k - 1) <= id_col, lo + k).otherwise(lo))
    return F.when(id_col.isNull(), 0).otherwise(found)


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """id, text, bucket, guest of every row and of guests, dealt by bucket, and the window in which a row's successor in
    falling order of ids is the next row. Guests are there to be seen only."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    n = ids.count()
    buckets = min(1 << MAX_BUCKET_BITS, max(1, n // BUCKET_DOCS))
    cuts = ids.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    bucket = _bucket(sorted(set(cuts or [])), F.col("id"))
    tops = stage(ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("id").alias("id")), "tops")  # one row a bucket
    order = Window.orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(order))
    wraps = F.lead("bucket").over(order).isNull()
    sent = tops.select("id", above.alias("to"), wraps.alias("wraps"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    guests = rows.join(F.broadcast(sent), rows["id"].eqNullSafe(sent["id"])).select(rows["id"], "t", F.col("to").alias("bucket"), F.when(F.col("wraps"), 2).otherwise(1).alias("guest"))
    both = rows.select("id", "t", bucket.alias("bucket"), F.lit(0).alias("guest")).unionByName(guests)
    return both.repartition("bucket"), Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), F.xxhash64("t"))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, floor: float = FLOOR) -> DataFrame:
    """Each row's fingerprint, that of its edited text, whose second half is the beginning of the next document, and how like
    they are: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures."""
    tune(docs.sparkSession)
    rows, w = with_next_text(docs, id_col, text_col)
    rows = rows.withColumn("s", signatures(F.col("t"), anchors, chain))
    # a bucket's own rows have one after them: another of its own or a guest
    seen = rows.withColumn("next_t", F.lead("t").over(w)).withColumn("next_s", F.lead("s").over(w)).where("guest = 0")
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring("next_t", F.lit(1), half))
    seen = seen.select("id", "t", "s", "next_s", edited.alias("e")).withColumn("es", signatures(F.col("e"), anchors, chain))
    return seen.select(F.col("id").alias(id_col), F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("es")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("es"), floor).alias("near_edited"), likeness(F.col("s"), F.col("next_s"), floor).alias("near_next"), F.size("s").cast("long").alias("n_signatures"))
