"""Large term lists, the Bloom filter, roll-ups and the log store, against brute force."""

import datetime
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice import queries as Q
from sluice.functions import rules as R
from sluice.functions import text as X
from sluice.operators import bloom, detect, rollups, term_index
from sluice.operators import console as K
from sluice.operators import traffic as T
from sluice.plans.verdicts import Layers, verdicts
from sluice.sources.logstore import LogStore


def some_docs(r, n):
    vocabulary = ["".join(r.choice("abcde-_é鳳 ") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 25)))) for i in range(n)] + [(n, None), (n + 1, ""), (0, "the same id again: zq-9")], vocabulary


@pytest.mark.parametrize("depth", [2, 32])
def test_terms_in_tasks_by_regexes(depth, monkeypatch):
    """Terms that overlap, repeat, are longer than what is followed of them, at ends of texts and of chunks."""
    monkeypatch.setattr(term_index, "DEPTH", depth)
    r = random.Random(depth)
    needles = ["".join(r.choice("ab_é-") for _ in range(r.randrange(1, 7))) for _ in range(80)]
    rows = [(k, n, k % 3 == 0) for k, n in enumerate([*needles, *needles[:20]])]
    texts = ["".join(r.choice("ab_é- ") for _ in range(r.randrange(0, 30))) for _ in range(200)]
    t, p = term_index.Terms(rows).found(texts)
    want = {(i, k) for i, x in enumerate(texts) for k, n, whole in rows if (re.search(rf"(?<!\w){re.escape(n)}(?!\w)", x, re.ASCII) if whole else n in x)}
    assert list(zip(t.tolist(), p.tolist(), strict=True)) == sorted(want) and len(want) > 1000
    assert len(term_index.Terms([]).found(texts)[0]) == 0


def test_texts_do_not_shuffle_to_a_list(spark):
    """Beyond the rows themselves only a row an id moves: runs of all texts, exploded, took the time at size."""
    docs = spark.createDataFrame([(1, "some text with word7 in it")], "doc_id long, norm string")
    terms = spark.createDataFrame([(1, "word7", "r")], "place long, value string, rule_id string")
    plan = term_index.term_list_hits(docs, "doc_id", "norm", None, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("shuffled", [False, True])
def test_term_lists_by_brute_force(spark, monkeypatch, shuffled):
    """Whatever run stands for a term, and with the index broadcast or shuffled, the terms are those of the short list."""
    if shuffled:
        monkeypatch.setattr(term_index, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(term_index, "SAMPLE", 20)
    r = random.Random(8)
    rows, vocabulary = some_docs(r, 150)
    values = [*vocabulary, "zq-9", "a b", "-", "ab cd ab", "ABC", "\\E.*", "鳳", None, ""]
    terms = [(k, v, f"r{k % 5}") for k, v in enumerate(values)]
    docs = X.with_hard_normalized(spark.createDataFrame(rows, "doc_id long, text string"), "text", "norm").select("doc_id", F.lower("norm").alias("norm"), F.lower("text").alias("raw"))
    got = {x.doc_id: [(h.place, h.value) for h in x.hits] for x in term_index.term_list_hits(docs, "doc_id", "norm", "raw", spark.createDataFrame(terms, "place long, value string, rule_id string")).collect()}
    want: dict[int, set] = {}
    for i, text in rows:
        if text is None:
            continue
        norm, raw = X.hard_normalize_text(text, X.folding())[0].lower(), text.lower()
        for k, v, _ in terms:
            if not v:
                continue
            n = X.hard_normalize_text(v, X.folding())[0].lower()
            plain = re.fullmatch("[A-Za-z0-9_-]+", v)
            if (n and n in norm) or (re.search(rf"(?<![A-Za-z0-9_]){re.escape(v.lower())}(?![A-Za-z0-9_])", raw) if plain else v.lower() in raw):
                want.setdefault(i, set()).add((k, v))
    assert got == {i: sorted(x) for i, x in want.items()} and len(got) > 100
    short = docs.where("doc_id = 5").select(F.explode(detect.term_hits(F.col("norm"), F.col("raw"), [R.Term(v, "x") for v in vocabulary if v.strip(" -_")])).alias("t"))
    assert {x.t for x in short.collect()} == {v for _, v in got.get(5, []) if v in vocabulary and v.strip(" -_")}


def test_plan_does_not_grow_with_the_list(spark):
    docs = spark.createDataFrame([(1, "some text with word77 in it")], "doc_id long, norm string")
    sizes = []
    for n in (10, 20_000):
        terms = spark.range(n).select(F.col("id").alias("place"), F.concat(F.lit("word"), "id").alias("value"), F.lit("r").alias("rule_id"))
        hits = term_index.term_list_hits(docs, "doc_id", "norm", None, terms)
        sizes.append(len(hits._jdf.queryExecution().optimizedPlan().toString()))
        got = hits.collect()
    assert [h.value for h in got[0].hits] == ["word7", "word77"] and abs(sizes[0] - sizes[1]) < 200


def test_bloom_filter_loses_nothing(spark):
    r = np.random.default_rng(1)
    kept, other = r.integers(-(1 << 63), (1 << 63) - 1, 5000), r.integers(-(1 << 63), (1 << 63) - 1, 50_000)
    df = spark.createDataFrame([(int(x),) for x in kept], "fp long")
    built, direct = bloom.build(df, len(kept)), bloom.of_array(kept)
    assert (built == direct).all() and len(built) * 64 == bloom.filter_bits(5000)
    assert set(bloom.accepted(built, kept.view(np.uint64)).tolist()) == set(kept.view(np.uint64).tolist())
    assert len(bloom.accepted(built, other.view(np.uint64))) < 0.05 * len(other)
    assert not len(bloom.accepted(bloom.of_array(kept[:0]), kept.view(np.uint64))) and not len(bloom.accepted(direct, kept[:0].view(np.uint64)))


def test_only_accepted_hashes_shuffle(spark):
    """Both ways find the same, on copies, repeated rows, nulls and an empty store; the filter lets few others through."""
    corpus = spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog again and again\nand one more protected line")], "name string, text string")
    rows = [(i, f"{'x' * i} the quick brown fox jumps over the lazy dog again and AGAIN {i}\nand one more  protected line") for i in range(20)] + [(7, "nothing"), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store = detect.fingerprint_store(corpus, "name", "text")
    for s in (store, store.limit(0)):
        few, many = (sorted(map(tuple, detect.with_fingerprint_hits(docs, F.col("text"), s, n).select("doc_id", "shingle_hits", "line_hits").collect())) for n in (10**6, 0))
        assert few == many and len(few) == len(rows)
    assert sum(x[1] for x in sorted(map(tuple, detect.with_fingerprint_hits(docs, F.col("text"), store, 0).select("doc_id", "shingle_hits").collect()))) > 100


def test_request_dimension_report(spark):
    """Sums before the join equal those after it, also where requests are missing, stand twice or have no id; and where each stands once,
    usage is joined only as sums by request."""
    r = random.Random(5)
    n = lambda: r.choice([None, r.randrange(100)])
    usage = spark.createDataFrame([(r.choice([None, *range(12)]), r.choice([None, 1, 2]), r.randrange(4), n(), n(), n(), n(), n(), n()) for _ in range(200)], "request_id long, c long, m long, input_tokens long, cached_tokens long, output_tokens long, reasoning_tokens long, written_tokens long, cost long")
    usage = usage.withColumn("cost", F.col("cost").cast("decimal(18,4)"))
    known = [(i, i % 3 or None, f"s{i % 2}") for i in range(12)]
    for rows, of in ((known, usage.where("request_id is not null")), (known, usage), (known[2:], usage), (known[1:] + known[:3] + [(3, 9, None), (None, 1, "x")], usage), (known[:0], usage)):
        asked = spark.createDataFrame(rows, "request_id long, k long, s string")
        got = rollups.request_dimension_report(of, asked, {"channel": "c", "model": "m"}, {"key": "k", "source": "s"})
        want = rollups.dimension_report(of.join(asked, "request_id"), {"channel": "c", "model": "m", "key": "k", "source": "s"})
        assert got.schema.names == want.schema.names and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (of is usage)


def test_dimension_report(spark):
    kind = "c long, m string, input_tokens long, cached_tokens long, output_tokens long, reasoning_tokens long, written_tokens long, cost double"
    rows = [(1, "a", 10, 2, 5, None, 1, 0.5), (1, None, 20, 0, 5, 3, None, 1.5), (2, "a", 30, 1, None, 2, 1, None)]
    got = {(r.dimension, r.key): r for r in rollups.dimension_report(spark.createDataFrame(rows, kind), {"channel": "c", "model": "m"}).collect()}
    assert set(got) == {("channel", "1"), ("channel", "2"), ("model", "a"), ("model", None), ("all", None)}
    assert (got["channel", "1"].requests, got["channel", "1"].reasoning_tokens, got["model", "a"].input_tokens, got["model", None].cost, got["all", None].output_tokens) == (2, 3, 40, 1.5, 10)
    assert rollups.dimension_report(spark.createDataFrame([], kind), {"channel": "c"}).count() == 0


def test_sketches_keep_their_error(spark):
    r = random.Random(2)
    at = lambda i: datetime.datetime(2024, 1, 1 + i % 3, i % 24, i % 60)
    rows = [("hot" if i % 3 else f"l{i % 4}", at(i), r.choice([None, int(r.expovariate(0.002)), 7])) for i in range(30_000)]
    log = spark.createDataFrame(rows, "layer string, ts timestamp_ntz, latency_ms long")
    days = rollups.daily_latency(rollups.latency_sketches(log))
    errors = rollups.rank_errors(log, days.drop("n")).collect()
    assert len(errors) == days.count() == 6 and sum(x.n for x in errors) == sum(v is not None for *_, v in rows)
    assert max(max(x.error_p50, x.error_p95) for x in errors) <= rollups.RANK_ERROR


def test_log_store(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 3, 1) + datetime.timedelta(hours=h, minutes=m)
    rows = [(i, at(i % 40, i % 60), "pg") for i in range(400)] + [(999, None, "odd")]
    log = LogStore(spark, str(tmp_path / "log"))
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, layer string")
    log.append(df.where("seq < 200"))
    log.append(df.where("seq >= 200"))
    lit = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    ids = lambda d: sorted(r.seq for r in d.collect())
    assert ids(log.read()) == sorted(i for i, *_ in rows) and log.hours().count() == 40
    between = log.read(lit(at(5, 10)), lit(at(30)))
    assert ids(between) == [i for i, t, _ in rows[:400] if at(5, 10) <= t < at(30)]
    assert "PartitionFilters: [" in between._jdf.queryExecution().toString() and log.preview(lit(at(20, 30))).first().n == sum(t < at(20, 30) for _, t, _ in rows[:400])
    assert log.retain(lit(at(20, 30))) == 20 and log.retain(lit(at(20, 30))) == 0
    assert ids(log.read()) == [i for i, t, _ in rows[:400] if t >= at(20, 30)] + [999]
    log.rewrite("2024-03-02", 3)
    assert ids(log.read()) == [i for i, t, _ in rows[:400] if t >= at(20, 30)] + [999]
    assert log.retain(lit(at(100))) == 20 and ids(log.read()) == [999]


def test_every_injection_group_meets_a_text(spark, tmp_path):
    rows = [(i, f"plain words {i}") for i in range(40)] + [(47, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: set(x.hit.split(",")) for x in Q.injection_all_groups(spark, str(tmp_path)).collect()}
    assert set().union(*got.values()) == {*R.INJECTION_GROUPS, "emotion", "apikey-exfil"}
    assert "apikey-exfil" not in got.get(16, set()) and 19 not in got


@pytest.mark.parametrize("name", ["block_excerpts", "injection_decoded"])
def test_detection_runs_once_a_row(spark, tmp_path, name):
    """A filter on a computed column would run all patterns again."""
    spark.createDataFrame([(0, "plain"), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = Q.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and x.count("RLIKE") > 1] and df.count() > 0


def test_a_judges_reply_is_parsed_once(spark):
    replies = ['```json{"injection":true,"confidence":"0.5","attack_type":"x"}```', '{"injection":0}', "  ```{}```  ", '{"confidence":"much"}', "[1]", "no", None]
    df = spark.createDataFrame([(r,) for r in replies], "r string").coalesce(1)
    for judged in (K.judged_text, K.judged_injection):
        plan = df.select(judged(F.col("r")).alias("j")).select("j.*")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1
    got = [x.j and tuple(x.j) for x in df.select(K.judged_injection(F.col("r")).alias("j")).collect()]
    assert got == [(True, 0.5, "x"), (False, 0.0, ""), (False, 0.0, ""), None, None, None, None]


def test_a_stream_event_is_parsed_once(spark):
    df = spark.createDataFrame([(1, 0, '{"choices":[{"delta":{"content":"a"}}]}'), (1, 1, "no"), (1, 2, '{"type":"response.output_text.delta","delta":"b"}'), (2, 0, None)], "k long, seq int, data string")
    got = T.assembled(df, "k", "seq", "data")
    assert {r.k: (r.content, r.reasoning, r.calls) for r in got.collect()} == {1: ("ab", "", []), 2: ("", "", [])}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_verdicts_compute_their_layers_once(spark):
    """Masking in two branches would run all layers before it twice."""
    df = spark.createDataFrame([(1, "call 13812345678 now"), (2, "plain words"), (3, None)], "doc_id long, text string")
    store = detect.fingerprint_store(spark.createDataFrame([(9, "a protected text of some length")], "item_id long, text string"), "item_id", "text")
    got = verdicts(df, "doc_id", "text", Layers(), store)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    assert {r.doc_id: (r.action, bool(r.entities), r.masked_text) for r in got.where("doc_id > 1").collect()} == {2: ("pass", False, "plain words"), 3: ("pass", False, None)}
    assert got.where("doc_id = 1").first().action == "mask"


def test_fingerprints_are_made_by_slices(spark, monkeypatch):
    monkeypatch.setattr(detect, "SLICE_ROWS", 3)
    parts = list(detect.sliced(iter([pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (7, 0, 3)])))
    assert [b.column(0).to_pylist() for b in parts] == [[0, 1, 2], [3, 4, 5], [6], [0, 1, 2]]
    df = spark.createDataFrame([(i, f"text {i} of a store " * 4) for i in range(10)], "item_id long, text string").coalesce(1)
    got = detect.fingerprint_matches(df, detect.fingerprint_store(df, "item_id", "text"), "item_id", "text", 1).collect()
    assert sorted(r.item_id for r in got) == list(range(10))
