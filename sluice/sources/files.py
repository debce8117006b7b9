"""Rule files, the fingerprint store's layouts, the verdict log and documents as sources and sinks."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sluice.functions import rules as R

LOG_SCHEMA = """seq long, ts double, layer string, hit boolean, score double, confidence double, latency_ms int, error string, entities int, blocked boolean,
 block_threshold double, model string, warned boolean, groups array<string>, attack_type string, resolved_model string, tier string, p_complex double, reason string, session boolean,
 rule_ids array<string>, side string, key_hash string, excerpts array<struct<rule:string,text:string>>, actor string, op string, changed array<string>"""


def _rows(spark: SparkSession, path: str, schema: str, field: str) -> list:
    """Elements of a JSON file's list; none if it is missing or malformed."""
    try:
        df = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path)
        return [x for r in df.collect() for x in r[0] or []]  # rule files are small by nature
    except AnalysisException:
        return []


def terms(spark: SparkSession, path: str) -> list[R.Term]:
    return [R.Term(x.value, x.rule_id) for x in _rows(spark, path, "value:string,rule_id:string", "terms") if x.value is not None]


def format_rules(spark: SparkSession, path: str) -> list[R.FormatRule]:
    """Rules of a file; patterns that don't compile are left out one by one."""

    def good(ps):
        out = []
        for p in ps or []:
            try:
                re.compile(p)
                out.append(p)
            except re.error:
                continue
        return tuple(out)

    got = _rows(spark, path, "code:string,action:string,enabled:boolean,entity:string,replacement:string,gateway_patterns:array<string>,shim_patterns:array<string>", "rules")
    return [R.FormatRule(x.code, x.action, good(x.shim_patterns), good(x.gateway_patterns), bool(x.enabled), x.entity, x.replacement) for x in got]


def recognizers(spark: SparkSession, path: str) -> list[R.Recognizer]:
    got = _rows(spark, path, "name:string,entity:string,patterns:array<struct<name:string,regex:string,score:double>>,context:array<string>,replacement:string", "recognizers")
    return [R.Recognizer(x.name, x.entity, p.regex, x.replacement, p.score or 0.0, tuple(x.context or ())) for x in got for p in x.patterns or []]


def fold_table(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of single characters by what they are read as: a JSON object {"鳳": "凤", ...}, for the ``fold`` of normalization;
    entries that aren't one character each are left out, a missing or malformed file gives none."""
    try:
        rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).collect()  # a rule file
    except AnalysisException:
        return {}
    return {k: v for r in rows for k, v in (r.m or {}).items() if k and v and len(k) == len(v) == 1}


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(doc, kind, fp) of a published store of SHA-256 fingerprints, {"docs": {name: value}}: a value is a list of shingles'
    (kind s) or an object of shingles and lines (l). What can't be read gives no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<docs:map<string,string>>")["docs"]).alias("doc", "v"))
    plain, parted = F.from_json("v", "array<string>"), F.from_json("v", "struct<shingles:array<string>,lines:array<string>>")
    none = F.array().cast("array<string>")
    kind = lambda k, a: F.transform(F.coalesce(a, none), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("fp")))
    listed = F.startswith(F.ltrim("v"), F.lit("["))
    rows = F.when(listed, kind("s", plain)).otherwise(F.concat(kind("s", parted["shingles"]), kind("l", parted["lines"])))
    return docs.select("doc", F.explode(rows).alias("x")).select("doc", "x.kind", "x.fp").where("fp is not null").distinct()


def append_log(records: DataFrame, path: str) -> None:
    """Appends verdict records as JSON lines; absent values aren't written."""
    records.write.mode("append").option("ignoreNullFields", True).json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a verdict log; blank and corrupt lines are skipped."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def decode_text(raw: bytes) -> str:
    """The first encoding that fits."""
    for name in ("utf-8-sig", "utf-8", "gbk", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _text(e) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def _row(cells: list[str]) -> str:
    """Cells joined by tabs, a cell equal to the one before it (a merged cell) once."""
    return "\t".join(c for i, c in enumerate(cells) if not i or c != cells[i - 1])


def _docx(z: zipfile.ZipFile) -> list[str]:
    body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for block in next(x for x in body.iter() if _local(x) == "body"):
        if _local(block) == "p":
            out.append(_text(block))
        elif _local(block) == "tbl":
            rows = [_row([_text(c) for c in r if _local(c) == "tc"]) for r in block if _local(r) == "tr"]
            out += [r for r in rows if r.strip()]
    return out


def _pptx(z: zipfile.ZipFile) -> list[str]:
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for n in names:
        root = ElementTree.fromstring(z.read(n))
        for x in root.iter():
            if _local(x) == "tr":
                out.append(_row([_text(c) for c in x if _local(c) == "tc"]))
            elif _local(x) == "txBody":
                out += [_text(p) for p in x.iter() if _local(p) == "p"]
    return [x for x in out if x.strip()]


def _xlsx(z: zipfile.ZipFile) -> list[str]:
    shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
        for r in ElementTree.fromstring(z.read(n)).iter():
            if _local(r) == "row":
                cells = []
                for c in r:
                    v = next((x.text or "" for x in c if _local(x) == "v"), _text(c))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(x.strip() for x in cells):
                    out.append("\t".join(cells))
    return out


def extract_text(name: str, raw: bytes | None, most_chars: int = 8_000_000) -> tuple[str | None, str | None]:
    """(text, None) or (None, error) of a document by its extension."""
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    if not raw:
        return None, "empty"
    if kind in ("doc", "xls", "ppt"):
        return None, "legacy format"
    try:
        if kind in ("txt", "md", "csv", "json", "log"):
            text = decode_text(raw)
        elif kind in ("docx", "xlsx", "pptx"):
            with zipfile.ZipFile(BytesIO(raw)) as z:
                if sum(i.file_size for i in z.infolist()) > 200_000_000:
                    return None, "too large"
                text = "\n".join({"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](z))
        else:
            return None, "unsupported"
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, IndexError):
        return None, "unreadable"
    if len(text) > most_chars:
        return None, "too large"
    return (text, None) if text.strip() else (None, "blank")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """name, text, error of the files under a folder."""
    src = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches):
        for b in batches:
            rows = [extract_text(n, c) for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["name", "text", "error"])

    return src.mapInArrow(run, "name string, text string, error string")
