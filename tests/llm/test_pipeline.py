"""The pipeline's stages on small tables with odd rows, each on its own input."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline

STAGES = dict(pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(k, n):
    return " ".join(f"{k}w{i}x" for i in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, text(i, 80), "en", f"s{i % 3}", 500) for i in range(60)]
    rows += [(100 + i, text(i, 79) + " tail", "en", "s0", 500) for i in range(5)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, text(7, 80), "en", "s1", 500), (3, text(3, 80), "en", "s0", 500)]
    rows += [(300, text(300, 60) + " " + " ".join(text(20, 80).split()[:60]), "en", "s2", 9)]
    rows += [(400 + i, f"vile nasty {text(400 + i, 60)}", "en", "s2", 9) for i in range(40)]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(400 + i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_take_effect(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, step) in enumerate(pipeline.STAGES):
        docs = step(spark, docs, folder)
        if i < 4:
            assert docs.columns == list(pipeline.COLUMNS)
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    ids = {n: [r.doc_id for r in rows] for n, rows in kept.items()}
    assert not {i for i in ids["toxicity"] if i >= 400} and set(range(60)) <= set(ids["toxicity"])
    assert sorted(i for i in ids["near_duplicates"] if i < 300) == [*range(60), 200, 201]
    cut = {r.doc_id: r.text for r in kept["repeated_passages"]}
    assert len(cut[300].split()) == 60 and cut[20].split()[0] == "20w0x" and 201 in cut
    # every copy's tokens are packed once: as many end tokens as rows, and the pieces of a document sum to its copies
    copies = Counter(ids["mixing"])
    total = Counter()
    for r in kept["packing"]:
        total[r.doc_id] += r.length
    assert {k: sum({r.doc_tokens for r in kept["packing"] if r.doc_id == k}) * n for k, n in copies.items()} == total
    assert sum(copies.values()) > len(copies) and not {200, 201} & set(copies)


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


ODD = [(None, text(1, 60), None, None, None), (None, text(1, 60), None, None, None), (5, text(2, 60), "en", "a", 1), (5, text(3, 60), "en", "a", 1), (5, text(3, 60), "en", "a", 1), (6, None, "en", "a", None), (7, "", "en", None, 0), (7, " \n", "en", None, 0), (8, text(4, 20_000), "en", "a", 1), (9, "word", "en", "b", 4)]


def keyed(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_odd_rows_in_every_stage(spark, folder):
    """Null and repeated ids, repeated rows, null, empty, wordless and very long texts."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    all_rows = Counter((r[0], r[1]) for r in ODD)
    assert keyed(STAGES["toxicity"](spark, docs, folder).collect()) == all_rows
    near = keyed(STAGES["near_duplicates"](spark, docs, folder).collect())
    assert near == Counter(set(all_rows)) and near[5, text(2, 60)] == near[5, text(3, 60)] == 1
    assert keyed(STAGES["repeated_passages"](spark, docs, folder).collect()) == all_rows
    mixed = keyed(STAGES["mixing"](spark, docs, folder).collect())
    assert not {k for k in mixed if not (k[1] or "").split()} and set(mixed) <= set(all_rows)
    assert all(n <= 2 * all_rows[k] for k, n in mixed.items())
    packed = defaultdict(int)
    for r in STAGES["packing"](spark, docs, folder).collect():
        packed[r.doc_id] += r.length
    assert packed.keys() == {None, 5, 6, 7, 8, 9} and packed[6] == 1 and packed[7] == 2


def test_empty_tables_in_every_stage(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for step in STAGES.values():
        assert step(spark, none, folder).count() == 0


def test_near_duplicates_and_passages_by_brute_force(spark, folder):
    """One row of each component stays, by set arithmetic over all pairs; planted passages go from all but the first holder."""
    r = random.Random(2)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(55)]
    rows = []
    for i in range(80):
        t = [word() for _ in range(70)]
        if i % 10 == 3:
            t = rows[-1][1].split()
            t[r.randrange(len(t))] = word()
        if i % 9 == 4:
            t = t[:20] + passage + t[20:]
        rows.append((i, " ".join(t), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, *_ in rows]
    root = list(range(80))
    for a in range(80):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    assert sorted(x.doc_id for x in STAGES["near_duplicates"](spark, docs, folder).collect()) == sorted(set(root))
    holders = [i for i, t, *_ in rows if " ".join(passage) in t]
    left = {x.doc_id: x.text for x in STAGES["repeated_passages"](spark, docs, folder).collect()}
    assert [i for i in holders if " ".join(passage[5:50]) in left.get(i, "")] == holders[:1]


def test_changed_passages_of_many_partial_holders_are_cut(spark):
    """The third and the last of twelve documents hold a passage, the last with every twelfth word changed; the others hold its parts apart."""
    r = random.Random(31)
    some = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    p, rows = some(60), []
    changed = [some(1)[0] if i % 12 == 8 else x for i, x in enumerate(p)]
    for i in range(12):
        whole = {2: p, 11: changed}.get(i)
        rows.append((i, " ".join(some(30) + (whole or p[:20] + some(90) + p[40:] + some(90) + p[20:40]) + some(30)), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {x.doc_id: len(x.text.split()) for x in STAGES["repeated_passages"](spark, docs, "").collect()}
    assert kept[2] == 120 and 60 <= kept[11] <= 65
