import random
import time

import pytest
from pyspark.sql import functions as F

from leafwright.operators import spans, tree
from leafwright.sources import adapters, files
from leafwright.streaming import ingest

def test_suppression_keeps_the_better_of_overlapping_spans(spark):
    got = spans.suppressed(spark.createDataFrame([(1, 1, 0, 10, "x", 0.5), (1, 2, 0, 9, "x", 0.9), (1, 3, 0, 10, "y", 0.1), (1, 4, 20, 30, "x", 0.2), (1, 5, 29, 50, "x", 0.3)], SPANS))
    assert sorted(r.span for r in got.collect()) == [2, 3, 4, 5]


def test_merging_compares_merged_spans_again(spark):
    got = spans.merged(spark.createDataFrame([(1, 1, 0, 4, "x", 0.5), (1, 2, 5, 8, "x", 0.4), (1, 3, 9, 12, "x", 0.9), (1, 4, 20, 22, "x", 0.1), (1, 5, 22, 25, "y", 0.1)], SPANS))
    assert sorted((r.a, r.b, r.score) for r in got.collect()) == [(0, 12, 0.4), (20, 22, 0.1), (22, 25, 0.1)]


SPANS = "doc long, span long, a long, b long, label string, score double"


def generated(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(400)
        rows.append((rng.randrange(4), i, a, a + rng.randint(1, 40), rng.choice("xy"), rng.choice([0.2, 0.5, 0.5, 0.9])))
    return rows


def plain_suppress(rows):
    out = []
    for r in sorted(rows, key=lambda r: (-r[5], -(r[3] - r[2]), r[1])):
        hit = False
        for o in out:
            if o[0] == r[0] and o[4] == r[4]:
                shared = max(0, min(o[3], r[3]) - max(o[2], r[2]))
                hit = hit or shared / min(o[3] - o[2], r[3] - r[2]) >= 0.8
        if not hit:
            out.append(r)
    return {r[1] for r in out}


def plain_merge(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        if out and out[-1][0] == r[0] and out[-1][3] == r[4] and r[2] <= out[-1][2] + 1:
            o = out[-1]
            out[-1] = (o[0], o[1], max(o[2], r[3]), o[3], min(o[4], r[5]))
        else:
            out.append((r[0], r[2], r[3], r[4], r[5]))
    return sorted(out)


def plain_match(rows):
    out, used = {}, set()
    for p in sorted(r for r in rows if r[1] % 2):
        best, found = 0, None
        for g in sorted(r for r in rows if r[1] % 2 == 0 and r[0] == p[0]):
            shared = min(p[3], g[3]) - max(p[2], g[2])
            if g[1] not in used and shared > best:
                best, found = shared, g[1]
        used.add(found)
        out[p[1]] = (found, best)
    return out


def test_span_folds_against_plain_loops(spark):
    rows = generated(3)
    df = spark.createDataFrame(rows, SPANS)
    assert {r.span for r in spans.suppressed(df).collect()} == plain_suppress(rows)
    assert sorted((r.doc, r.a, r.b, r.label, r.score) for r in spans.merged(df).collect()) == plain_merge(rows)
    sides = df.withColumn("side", F.when(F.col("span") % 2 == 0, "gold").otherwise("pred"))
    got = spans.greedy_match(sides).collect()
    assert {r.span: (r.gold_span, r.shared) for r in got} == plain_match(rows)


def test_calls_leave_a_row_for_each_request(spark):
    def make():
        def client(request):
            if request == "bad":
                raise ValueError("content_filter")
            if request == "slow":
                time.sleep(1.5)
            return request.upper()

        return client

    df = spark.createDataFrame([("1", "a"), ("1", "bad"), ("2", "slow"), (None, "b")], "request_id string, request string").coalesce(1)
    got = sorted(((r.request_id or "", r.response, r.status) for r in adapters.call(df, make, 2, 0.01, 0.3).collect()), key=str)
    assert got == [("", "B", "ok"), ("1", "A", "ok"), ("1", None, "error"), ("2", None, "error")]


def test_greedy_match_depends_on_order(spark):
    rows = [(1, 1, 0, 10, "x", 1.0, "pred"), (1, 2, 0, 12, "x", 1.0, "pred"), (1, 3, 0, 11, "x", 1.0, "gold"), (1, 4, 8, 12, "x", 1.0, "gold")]
    got = spans.greedy_match(spark.createDataFrame(rows, SPANS + ", side string"))
    assert sorted((r.span, r.gold_span, r.shared) for r in got.collect()) == [(1, 3, 10), (2, 4, 4)]


def test_bio(spark):
    tags = ["I-a", "O", "B-a", "I-a", "I-b", "O", "B-b", "B-b"]
    rows = [(1, i, 10 * i, 10 * i + 9, t, 1.0 - i / 10) for i, t in enumerate(tags)]
    got = spans.bio_spans(spark.createDataFrame(rows, "doc long, pos long, a long, b long, tag string, score double"))
    assert sorted((r.a, r.b, r.label) for r in got.collect()) == [(20, 39, "a"), (40, 49, "b"), (60, 69, "b"), (70, 79, "b")]


def test_tree(spark):
    rows = [("D", "inclusion", "i1", 0, k, c, f"C{k}", k == 2) for k, c in enumerate(["AND", "OR", None, "AND"])] + [("D", "exclusion", "i2", 0, 0, None, "X", False)]
    items = tree.assemble(spark.createDataFrame(rows, "document_id string, section string, item_uid string, item_index int, ord int, connector string, criterion_id string, negated boolean"))
    got = {r.criterion_id: (r.path, r.negated) for r in tree.walk(items).collect()}
    root = "inclusion_criteria.children[0]"
    assert got == {"C0": (f"{root}.children[0].children[0]", False), "C1": (f"{root}.children[0].children[1]", False), "C2": (f"{root}.children[1]", True), "C3": (f"{root}.children[2]", False), "X": ("exclusion_criteria.children[0]", False)}
    assert tree.documents(items).count() == 2


def test_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("name,x\nMüller,1\n".encode("cp1252"))
    assert [r.name for r in files.read_csv(spark, str(path)).collect()] == ["Müller"]
    path.write_bytes(b"\xef\xbb\xbfname,x\nM,1\n")
    assert files.read_csv(spark, str(path)).columns == ["name", "x"]
    assert files.read_optional(spark, str(tmp_path / "no"), "a int").count() == 0
    df = spark.createDataFrame([("k1", True, [1, 2]), ("k2", None, None)], "key string, ok boolean, many array<int>")
    files.write_csv(df, str(tmp_path / "out"), ("ok",))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).na.fill("").collect()) == [("", "k2", ""), ("1", "k1", "[1,2]")]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_csv(df, str(tmp_path / "out"))
    rows = spark.createDataFrame([("a", "ok"), ("b", "error")], "id string, status string")
    assert files.append_missing(rows, str(tmp_path / "sink"), "id") == 2
    assert files.append_missing(rows, str(tmp_path / "sink"), "id") == 1


def test_adapters(spark):
    requests = spark.createDataFrame([("1", "x"), ("2", "fail")], "request_id string, request string")
    recorded = spark.createDataFrame([("1", "old", 1), ("1", '```json\n{"a": 1}\n```', 2)], "request_id string, response string, recorded_at int")
    got = {r.request_id: r for r in adapters.parsed_json(adapters.replay(requests, recorded)).selectExpr("*", "cast(json as string) as j").drop("json").collect()}
    assert (got["1"].status, got["1"].parse_status, got["1"].j) == ("ok", "ok", '{"a":1}') and (got["2"].status, got["2"].parse_status) == ("error", "empty")

    def make():
        def client(text):
            if text == "fail":
                raise ValueError("content_filter")
            return text.upper()

        return client

    called = {r.request_id: (r.response, r.status) for r in adapters.call(requests, make).collect()}
    assert called == {"1": ("X", "ok"), "2": (None, "error")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:00")], "key string, at string").write.json(str(tmp_path / "in"))
    stream = ingest.stream_jsonl(spark, str(tmp_path / "in"), "key string, at timestamp")
    for _ in range(2):
        ingest.append_once(stream, str(tmp_path / "out"), str(tmp_path / "marks"), "key", "at").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_csv_encoding_shows_late(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"name,x\n" + b"Miller,1\n" * 3000 + "Müller,2\n".encode("cp1252"))
    assert [r.name for r in files.read_csv(spark, str(path)).where("x = 2").collect()] == ["Müller"]
