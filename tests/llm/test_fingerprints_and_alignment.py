"""Importance resampling, spot fingerprints and cross-tokenizer alignment against brute force, and on odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluice.llm import cross_tokenizer, importance_resampling, queries, spot_fingerprints
from sluice.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, id long, t string, s string, rank int, row int, bucket string"
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts():
    r = random.Random(12)
    vocabulary = ["the", "of", "and", "die", "der", "que", "é", "Éte", "naïve.", "x1", "中文", "don't"] + ["".join(r.choice("aeioutnrs") for _ in range(r.randrange(2, 7))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [text(r.randrange(1, 120)) for _ in range(50)]
    out += [out[0], out[0], out[1] + " more", None, "", " \n\t", "###", "the of and", "the", "one", "One, two", "\x00 a\x01b", "<|endoftext|> <s> </s> <0x41> ▁x", "  two  spaces ", "line\nbreak\r\n", "🙂👍🏽 emoji", "ﬁ ﬀ ²", "the " * 4000, "a" * 5000, text(6000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t) for i, t in enumerate(some_texts())]
    rows += [(None, "null id " * 30), (None, None), (6, "another text of a repeated id"), (9, rows[3][1])]
    return spark.createDataFrame([(*x, 7, "clash", "clash", 1, 2, "b") for x in rows], DOCS).repartition(5)


def features(t, n=2):
    w = FEATURE.findall((t or "").translate(A_TO_Z))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def test_importance_resampling(spark, docs):
    target = ["the of x1 and", "é Éte the", None]
    got = importance_resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rows = docs.select("doc_id", "text").collect()
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r.text for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    want = []
    for r in rows:
        w, f = features(r.text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        want.append((r.doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert sorted(map(str, want)) == sorted(str((g.doc_id, g.n_words, g.n_features, g.weight, g.score)) for g in got)
    able = sorted((-x[4], x[0] is None, x[0] or 0, x[2], x[3]) for x in want if x[1] >= 20)
    drawn = able[: 25 * len(able) // 100]
    ranked = {g["rank"]: (-g.score, g.doc_id is None, g.doc_id or 0, g.n_features, g.weight) for g in got if g["rank"] is not None}
    assert ranked == {k + 1: x for k, x in enumerate(drawn)} and len(drawn) > 5


@pytest.mark.parametrize(("n", "piece"), [(1, 3), (2, 5), (3, 7), (4, 1 << 20)])
def test_crc_ring_over_pieces(n, piece, monkeypatch):
    """Pieces carry the ring: features that span them are found once, whatever their size."""
    monkeypatch.setattr(importance_resampling.word_pieces, "__defaults__", (piece,))
    for t in some_texts():
        words, buckets = importance_resampling.text_buckets(None if t is None else t.encode(), n, 1 << 20)
        w, f = features(t, n)
        assert words == len(w) and Counter(buckets.tolist()) == Counter(zlib.crc32(x.encode()) % (1 << 20) for x in f)


def test_ranks_over_many_partitions(spark, docs, monkeypatch):
    target = spark.createDataFrame([("the of",)], "text string")
    one = importance_resampling.resample(docs, target, percent=60).collect()
    monkeypatch.setattr(importance_resampling, "RANKED_ROWS", 7)
    many = importance_resampling.resample(docs, target, percent=60).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    ids = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    picked = importance_resampling.drawn(ids, importance_resampling.resample(ids, target, percent=60)).collect()
    assert {x.t for x in picked} == {"clash"} and len(picked) == max(x["rank"] for x in picked)


def test_resampling_of_nothing(spark, docs):
    empty = docs.where("false")
    assert importance_resampling.resample(empty, docs).count() == 0
    got = importance_resampling.resample(docs, empty).collect()
    assert len(got) == docs.count() and max(g["rank"] or 0 for g in got) > 0


def spot_set(t):
    """Signatures of a text, word by word."""
    w = FEATURE.findall(t.lower())
    common = set(spot_fingerprints.ANCHORS)
    found = set()
    for i, x in enumerate(["^", *w]):
        chain = [y for y in w[i:] if y not in common][:2]
        if chain and (i == 0 or x in common):
            found.add(" ".join([x, *chain]))
    if not found and t:
        found = {"!" + t} if not w else {" ^ " + " ".join(w)}
    return {hashlib.md5(x.encode()).hexdigest()[:10] for x in found}


def jaccard(a, b):
    if a == b:
        return 1.0
    if not a or not b or min(len(a), len(b)) < spot_fingerprints.FLOOR * max(len(a), len(b)):
        return 0.0
    return len(a & b) / len(a | b)


def neighbours_by_brute_force(rows):
    """By place in the order; ids are distinct here."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = spot_set(t), spot_set(edited), spot_set(after)
        print_ = lambda s: base64.b64encode(bytes.fromhex("".join(sorted(s)))).decode()
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), print_(a), print_(b), round(jaccard(a, b), 9), round(jaccard(a, c), 9))
    return out


@pytest.mark.parametrize("per_bucket", [500, 4])
def test_spot_fingerprints(spark, monkeypatch, per_bucket):
    """The same neighbours for one bucket and for many, whose ends are joined by guests."""
    monkeypatch.setattr(spot_fingerprints, "BUCKET_DOCS", per_bucket)
    rows = [(i * 7 % 997, t) for i, t in enumerate(some_texts())]
    once = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in spot_fingerprints.compare_neighbours(once).collect()}
    assert got == neighbours_by_brute_force(rows)


def test_spot_fingerprints_on_odd_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(spot_fingerprints, "BUCKET_DOCS", 3)
    got = spot_fingerprints.compare_neighbours(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    by_text = defaultdict(set)
    for r in spot_fingerprints.fingerprints(docs.withColumn("doc_id", docs.text)).collect():
        by_text[r.doc_id or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""} and by_text["###"] != by_text[" \n\t"]
    for rows in ([], [(5, "alone of all")], [(None, "a b"), (None, None)], [(1, "x y"), (1, "x y"), (1, "z")]):
        got = spot_fingerprints.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert [r.near_next for r in spot_fingerprints.compare_neighbours(spark.createDataFrame([(5, "alone of all")], "doc_id long, text string")).collect()] == [1.0]


def test_halves_stay_alike(spark):
    """A text is nearer to its edited form than to an unrelated text."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = spot_fingerprints.compare_neighbours(documents).where("n_chars > 400").collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95 and np.mean([r.near_edited for r in got]) > 0.25


def align_by_loop(texts, a, b, bytes_a, bytes_b):
    """Groups, links, counts and sums, token by token."""
    docs, holders = [], defaultdict(set)
    for k, t in enumerate(texts):
        ids_a, ids_b, want = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t), (" " + t).encode()) if t else ([], [], b"")
        if not t or b"".join(map(bytes_a, ids_a)) != want or b"".join(map(bytes_b, ids_b)) != want:
            docs.append(([], [], [], []))
            continue
        ends = lambda ids, of: [sum(len(of(x)) for x in ids[: i + 1]) for i in range(len(ids))]
        if len(ids_a) > 500:
            ends = lambda ids, of: np.cumsum([len(of(x)) for x in ids]).tolist()
        ends_a, ends_b = ends(ids_a, bytes_a), ends(ids_b, bytes_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = [], []
            while i < len(ids_a) and ends_a[i] <= c:
                x.append(ids_a[i])
                i += 1
            while j < len(ids_b) and ends_b[j] <= c:
                y.append(ids_b[j])
                j += 1
            groups.append((x, y))
        links = [(p, q) for x, y in groups for p in x for q in y]
        for pair in links:
            holders[pair].add(k)
        docs.append((ids_a, ids_b, groups, links))
    most = defaultdict(int)
    for (p, _), h in holders.items():
        most[p] = max(most[p], len(h))
    out = []
    for ids_a, ids_b, groups, links in docs:
        n = [len(holders[x]) for x in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(c == most[x[0]] for c, x in zip(n, links, strict=True)), sum(n), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@pytest.mark.parametrize(("group", "links"), [(1 << 21, 1 << 21), (9, 60)])
def test_cross_tokenizer(docs, monkeypatch, group, links):
    """Also with ids dealt over many groups and postings in many small blocks."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    chars = cross_tokenizer.byte_characters()
    entries = {i: t for t, i in a.get_vocab().items()}
    bytes_a = lambda i: bytes(chars[c] for c in entries[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows = docs.select("doc_id", "text").collect()
    want = align_by_loop([r.text for r in rows], a, b, bytes_a, bytes_b)
    monkeypatch.setattr(cross_tokenizer, "BLOCK_LINKS", links)
    monkeypatch.setattr(cross_tokenizer, "HELD", links)
    got = cross_tokenizer.cross_align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), group_postings=group).collect()
    assert sorted(str((g.doc_id, *g[1:])) for g in got) == sorted(str((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))
    assert sum(w[0] > 0 for w in want) > 40 and sum(w[0] == 0 for w in want) >= 4
    pairs = cross_tokenizer.aligned_pairs(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).collect()
    assert sum(p.n_docs for p in pairs) == sum(len({(p, q) for x, y in g for p in x for q in y}) for g in groups_of(rows, a, b, bytes_a, bytes_b))


def groups_of(rows, a, b, bytes_a, bytes_b):
    for r in rows:
        if not r.text:
            continue
        x, y, raw = a.encode(" " + r.text, add_special_tokens=False).ids, b.encode(r.text), (" " + r.text).encode()
        if b"".join(map(bytes_a, x)) == raw == b"".join(map(bytes_b, y)):
            cuts, group_a, group_b = cross_tokenizer.groups(np.cumsum([len(bytes_a(i)) for i in x]), np.cumsum([len(bytes_b(i)) for i in y]))
            held = [([], []) for _ in cuts]
            for i, g in zip(x, group_a, strict=True):
                held[g][0].append(i)
            for i, g in zip(y, group_b, strict=True):
                held[g][1].append(i)
            yield held


def test_large_groups_give_pairs_by_distinct_ids(monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 5, 300), r.integers(0, 4, 280)
    group_a, group_b = np.sort(r.integers(0, 3, 300)), np.sort(r.integers(0, 3, 280))
    want = Counter((g, x, y) for g, x in zip(group_a, a, strict=True) for h, y in zip(group_b, b, strict=True) if g == h)
    for limit in (0, 4096, 1 << 30):
        monkeypatch.setattr(cross_tokenizer, "LARGE_GROUP", limit)
        got = Counter()
        for g, x, y, m in zip(*cross_tokenizer.linked_pairs(a, group_a, b, group_b), strict=True):
            got[(g, x, y)] += int(m)
        assert got == want


def test_empty_tables(docs):
    empty = docs.where("false")
    assert spot_fingerprints.compare_neighbours(empty).count() == 0
    assert cross_tokenizer.cross_align(empty, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_sql_of_the_queries(spark, tmp_path):
    """The registered SQL agrees on odd texts too."""
    import duckdb

    rows = [(i, t) for i, t in enumerate(some_texts()) if t is None or "\x00" not in t]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the of x1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("op11_importance_resampling", "op12_spot_fingerprints"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), name
