"""Sources and sinks: JSON lines, encodings, discovery, summaries, model calls."""

import json
import time

import pytest
from pyspark.sql import functions as F

from leafwright.sources import adapters, files

SCHEMA = "id long, name string, clauses array<string>"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id": 1, "name": "ü"}\n\n  \n{"id": 2, "name": null, "more": 1}\n', encoding="utf-8")
    assert [(r.id, r.name) for r in files.read_jsonl(spark, str(path), SCHEMA).orderBy("id").collect()] == [(1, "ü"), (2, None)]
    path.write_text('{"id": 1}\n{"id": 2\n{"id": 3}\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed|FAILFAST"):
        files.read_jsonl(spark, str(path), SCHEMA).collect()
    assert sorted(str(r.id) for r in files.read_jsonl(spark, str(path), SCHEMA, strict=False).collect()) == ["1", "3", "None"]
    out = str(tmp_path / "out")
    files.write_jsonl(spark.createDataFrame([(1, None, ["a"])], SCHEMA), out)
    (line,) = [r.value for r in spark.read.text(out).collect()]
    assert json.loads(line) == {"id": 1, "name": None, "clauses": ["a"]}


def test_windows_signs(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("name,n\nMüller – “so”,5 €\n".encode("cp1252"))
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [("Müller – “so”", "5 €")]


def test_discovery(spark, tmp_path):
    for name, n in (("run_1.jsonl", 1), ("run_2.jsonl", 3), ("run_3.jsonl", 2)):
        (tmp_path / name).write_text(json.dumps({"id": 1, "clauses": ["c"] * n}) + '\n{"id": 2}\n')
    at = lambda name: str(tmp_path / name)
    assert files.discovered(spark, (at("no"), at("run_1.jsonl"), at("run_2.jsonl"))) == at("run_1.jsonl")
    assert files.discovered(spark, (at("no"),), at("run_*.jsonl")).endswith("run_3.jsonl")
    with pytest.raises(FileNotFoundError, match="none of"):
        files.discovered(spark, (at("no"),), at("x*"))
    assert files.fullest(spark, [at(f"run_{k}.jsonl") for k in (1, 2, 3)], SCHEMA) == at("run_2.jsonl")


def test_summary(spark, tmp_path):
    out = str(tmp_path / "summary")
    files.write_summary(spark.createDataFrame([(1, None, ["a", "b"])], SCHEMA), out)
    assert json.loads("\n".join(r.value for r in spark.read.text(out, wholetext=True).collect())) == {"id": 1, "name": None, "clauses": ["a", "b"]}
    with pytest.raises(ValueError, match="one row"):
        files.write_summary(spark.range(2), out)


def test_rows_are_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def paid(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(k, "ok") for k in range(5)], "id long, status string").mapInArrow(paid, "id long, status string")
    assert files.append_missing(rows, str(tmp_path / "sink"), "id") == 5 and calls.value == 5
    assert files.append_missing(spark.createDataFrame([(k, "ok") for k in range(7)], "id long, status string"), str(tmp_path / "sink"), "id") == 2
    assert spark.read.json(str(tmp_path / "sink")).count() == 7


def test_many_hanging_calls_hold_up_none(spark):
    def make():
        def client(request):
            if request.startswith("hang"):
                time.sleep(30)
            return request.upper()

        return client

    df = spark.createDataFrame([(str(k), "hang" if k % 2 else "a") for k in range(160)], "request_id string, request string").coalesce(2)
    began = time.time()
    got = adapters.call(df, make, 1, 0.01, 0.2).collect()
    assert sorted((int(r.request_id), r.status) for r in got) == [(k, "error" if k % 2 else "ok") for k in range(160)]
    assert time.time() - began < 25


def test_answers_as_objects(spark):
    said = {"1": '```json\n{"a": 1}\n```', "2": 'Sure: {"a": {"b": 2}} .', "3": "[1]", "4": "7", "5": '{"a": ', "6": " ", "7": None, "8": 'JSON {"a": 1}'}
    got = adapters.parsed_json(spark.createDataFrame(list(said.items()), "id string, response string")).select("id", "parse_status", F.expr("to_json(json)").alias("j")).collect()
    assert {r.id: r.parse_status for r in got} == {"1": "ok", "2": "ok", "3": "not_object", "4": "not_object", "5": "error", "6": "empty", "7": "empty", "8": "ok"}
    assert {r.id: r.j for r in got}["2"] == '{"a":{"b":2}}'
