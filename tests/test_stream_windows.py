"""Session windows and the stream-stream join against batch versions on input without late rows."""

import datetime
import random

from pyspark.sql import functions as F

from sluice.operators import masking
from sluice.streaming import windows


def run(spark, tmp_path, batches, schema, make, name="one"):
    src, out = str(tmp_path / name), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        make(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_session_islands(spark, tmp_path):
    r, at, rows = random.Random(4), 1_000_000, []
    for _ in range(300):
        at += r.choice([1, 30, 200])
        rows.append((r.choice(["a", "b", "c", None]), at))
    rows += [("a", at + 600), ("b", at + 601 + 600), ("a", at + 1200), ("end", at + 100_000)]
    rows.sort(key=lambda x: x[1])
    got = run(spark, tmp_path, [rows[:100], rows[100:200], rows[200:]], "session string, at long", lambda s: windows.session_islands(s, ttl=600))
    want, held = [], {}
    for s, t in rows:
        if s is None:
            continue
        if s in held and t - held[s][1] <= 600:
            held[s] = (held[s][0], t, held[s][2] + 1)
        else:
            if s in held:
                want.append((s, *held[s]))
            held[s] = (t, t, 1)
    want += [(s, *v) for s, v in held.items() if s != "end"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 3


def test_requests_meet_their_usage(spark, tmp_path):
    """Usage of later batches still meets its request, up to the bound."""
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    requests = [[(1, day(0), "a"), (2, day(1), "b")], [(3, day(30), "a")], [(4, day(60), "a")]]
    usage = [[(1, day(0), 10, 1), (9, day(1), 5, 5)], [(1, day(29), 20, 2), (2, day(31), 30, 3), (2, day(32), 99, 9)], [(4, day(59), 7, 7), (3, day(60), 40, 4)]]
    kinds = "request_id long, created_at timestamp_ntz, source string", "request_id long, created_at timestamp_ntz, input_tokens long, output_tokens long"
    for r, u in zip(requests, usage, strict=True):
        spark.createDataFrame(r, kinds[0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        spark.createDataFrame(u, kinds[1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
        a, b = (spark.readStream.schema(k).parquet(str(tmp_path / n)) for k, n in zip(kinds, "ru", strict=True))
        windows.requests_with_usage(a, b, "30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.request_id, x.source, x.input_tokens) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a", 10), (1, "a", 20), (2, "b", 30), (3, "a", 40)]


def test_disjoint_spans_by_brute_force():
    """Each span is held only against its neighbours among the kept ones."""
    r = random.Random(9)
    for _ in range(300):
        spans = [(s, s + r.randrange(1, 9)) for s in (r.randrange(60) for _ in range(r.randrange(30)))]
        kept = []
        for a, b in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
            if all(b <= c or d <= a for c, d in kept):
                kept.append((a, b))
        assert [spans[k] for k in masking.longest_apart(spans)] == sorted(kept)


def test_recognizers_with_merged_spans(spark):
    """Merging beside recognition equals merging as a column."""
    rows = [(0, "call 13812345678 or 4123456789012345 or 11010519491231002X"), (1, "none"), (2, None), (3, "4123456789012345678 13812345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = masking.recognizer_spans(df, "text").withColumn("spans", masking.merge_spans(F.col("spans")))
    b = masking.recognizer_spans(df, "text", merged=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
