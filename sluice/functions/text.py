"""Text functions as column expressions; Arrow only where Spark has no Unicode compatibility forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import rules as R

SHINGLE, MIN_LINE = 50, 12
#: Code points outside these may change under compatibility normalization or folding.
_PLAIN = r"^[\x00-\x7F\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}]*$"


def fp_normalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """All windows of ``size`` characters of the normalized text; the whole of a shorter one that isn't empty."""
    n = fp_normalize(text)
    return F.when(F.length(n) >= size, F.regexp_extract_all(n, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))).when(F.length(n) > 0, F.array(n)).otherwise(F.array().cast("array<string>"))


def let(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


_MASK, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, size: int = SHINGLE, distinct: bool = True) -> np.ndarray:
    """64-bit hashes of ``shingles`` of an already normalized text, sorted and distinct unless told otherwise: sums of code
    points times powers of an odd base, taken as differences of running sums, so the cost doesn't depend on ``size``."""
    c = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(c)
    if not n:
        return c
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    w = min(size, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(c * np.uint64(_BASE)) * _POWERS[0][:n], dtype=np.uint64)])
    hashes = _mixed(_mixed((sums[w:] - sums[:-w]) * _POWERS[1][: n - w + 1] ^ np.uint64(w)))
    return np.unique(hashes) if distinct else hashes


def long_lines(text: Column, min_length: int = MIN_LINE) -> Column:
    """Distinct normalized lines of min_length characters or more."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), fp_normalize)
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) >= min_length))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def _half_width() -> tuple[str, str]:
    return "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def rule_normalize(text: Column) -> Column:
    """For injection rules: invisible characters out, full width to half, traditional to simplified, separators out, lower."""
    pairs = dict(zip(*_half_width(), strict=True)) | dict(zip(R.TRADITIONAL, R.SIMPLIFIED, strict=True))
    kept = {a: b for a, b in pairs.items() if b not in R.SEPARATORS}
    gone = "".join(dict.fromkeys([*R.INVISIBLE, *R.SEPARATORS, *(a for a in pairs if a not in kept)]))
    return F.lower(F.translate(text, "".join(kept) + gone, "".join(kept.values())))


def folding(extra: dict[str, str] | None = None) -> dict[str, str]:
    """Single characters by what they are read as: traditional forms and, given by the caller, homoglyphs and more forms."""
    return dict(zip(R.TRADITIONAL, R.SIMPLIFIED, strict=True)) | (extra or {})


def hard_normalize_text(text: str, fold: dict[str, str]) -> tuple[str, list[int]]:
    """Compatibility form of each code point, folded, without separators and zero-width characters; and each kept
    character's place in the text."""
    import unicodedata

    drop, out, at = set(R.SEPARATORS + R.ZERO_WIDTH), [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c):
            y = fold.get(x, x)
            if y not in drop:
                out.append(y)
                at.append(i)
    return "".join(out), at


def with_hard_normalized(df: DataFrame, text: str, out: str, fold: dict[str, str] | None = None) -> DataFrame:
    """Adds the hard-normalized text. Plain Latin rows stay in the JVM; only the others visit Python."""
    table = folding(fold)
    plain = F.coalesce(F.col(text).rlike(_PLAIN), F.lit(True))
    latin = {k: v for k, v in table.items() if ord(k) < 0x180}
    native = df.where(plain).withColumn(out, F.translate(F.translate(F.col(text), "".join(latin), "".join(latin.values())) if latin else F.col(text), R.SEPARATORS, ""))
    place = df.columns.index(text)

    def run(batches):
        for b in batches:
            norm = [None if t is None else hard_normalize_text(t, table)[0] for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm, pa.string())], names=[*b.schema.names, out])

    schema = native.schema
    return native.unionByName(df.where(~plain).mapInArrow(run, schema))


def printable(text: Column, unassigned: bool = False) -> Column:
    """More than nine tenths of the characters are printable or white space; empty texts are not. Code points that Unicode has
    not assigned, which depends on its version, are printable only with ``unassigned``."""
    bad = F.regexp_count(text, F.lit(rf"[{r'\p{Cc}\p{Cf}\p{Cs}\p{Co}' if unassigned else r'\p{C}'}&&[^\t\n\r\u000B\f\u001C-\u001F\u0085]]"))
    return (F.length(text) > 0) & ((F.length(text) - bad) / F.length(text) > 0.9)


def _decoded(token: Column, kind: str) -> Column:
    raw = F.try_to_binary(token, F.lit(kind))
    return F.try_validate_utf8(raw.cast("string"))


def decode_base64(text: Column, unassigned: bool = False) -> Column:
    """Distinct printable texts hidden in base64-like tokens of the text."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/]{16,}={0,2}"), F.lit(0)))
    whole = F.filter(tokens, lambda t: F.length(t) % 4 == 0)
    return F.filter(F.transform(whole, lambda t: _decoded(t, "base64")), lambda s: F.coalesce(printable(s, unassigned), F.lit(False)))


def decode_hex(text: Column, unassigned: bool = False) -> Column:
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9a-fA-F]{24,}"), F.lit(0)))
    whole = F.filter(tokens, lambda t: F.length(t) % 2 == 0)
    return F.filter(F.transform(whole, lambda t: _decoded(t, "hex")), lambda s: F.coalesce(printable(s, unassigned), F.lit(False)))


def decoded_texts(text: Column, unassigned: bool = False) -> Column:
    """Both levels of base64 and one of hex, distinct: all of them, however many and long."""
    hexes = decode_hex(text, unassigned)
    return let(decode_base64(text, unassigned), lambda first: F.array_distinct(F.concat(first, F.flatten(F.transform(first, lambda t: decode_base64(t, unassigned))), hexes)))


def simple_token(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_-]*[A-Za-z0-9][A-Za-z0-9_-]*$")


def safe_model_name(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._:/-]{1,128}\z")


def model_pattern(name: Column, pattern: str, is_filter: bool = False) -> Column:
    """Whether a model name fits: empty fits all (a filter's none), * all, plain text exactly, else the whole as a regex."""
    import re

    if not pattern:
        return F.lit(not is_filter)
    if pattern == "*":
        return F.lit(True)
    if not re.search(r"[\\^$.|?*+()\[\]{}]", pattern):
        return name == pattern
    body = pattern.removeprefix("(?i)")
    try:
        re.compile(body)
    except re.error:
        return F.lit(False)
    return name.rlike(f"{'(?i)' if body != pattern else ''}^(?:{body})$")


def excerpt(text: Column, width: int = 200) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).otherwise(t)


# --- times at a fixed offset ------------------------------------------------------------------------------------------
def zoned_text(at: Column, offset: str = "+08:00", pattern: str = "yyyy-MM-dd HH:mm:ss 'UTC+8'") -> Column:
    """A time as text at an offset from UTC, whatever the session's zone; times without a zone are taken as the session's."""
    return F.date_format(F.convert_timezone(None, F.lit(offset), at), pattern)


def day_key(at: Column, offset: str = "+08:00") -> Column:
    return zoned_text(at, offset, "yyyyMMdd")


def iso_zoned(text: Column, offset: str = "+08:00") -> Column:
    """An ISO time as zoned_text; a null as an empty text, other texts as they are."""
    at = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(text).cast("timestamp"))
    return F.coalesce(zoned_text(at, offset), text, F.lit(""))
