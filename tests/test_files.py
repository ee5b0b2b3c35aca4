"""Files with broken parts: rows, and rejects with their file and place; and parsing of raw results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evspark.operators import ingest
from evspark.sources.files import read_csv, read_json_lines, write_rejects

TYPES = {"question_id": "bigint", "question": "string", "score": "double"}
LINES = [
    '{"question_id": 1, "question": "a\\nb", "score": 2.5, "extra": {"k": [1, null]}}', "", '{"question_id": 2, "quest', "  ", "[1]", '{"question_id": "x", "question": "c"}',
    '{"question_id": "3", "question": null, "score": ""}', "7", '{"question_id": 4, "score": "none"}', "{}",
]


def test_json_lines(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(LINES) + "\n")
    rows, rejects = read_json_lines(spark, str(tmp_path), TYPES)
    got = sorted(rows.select("question_id", "question", "score", F.to_json("rest").alias("rest")).collect(), key=str)
    want = [(1, "a\nb", 2.5, '{"extra":{"k":[1,null]}}'), (3, None, None, None), (None, None, None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want * 2, key=str)
    bad = {(r.file[-7:], r["at"]): (r.raw, r.reason) for r in rejects.collect()}
    reasons = {3: "no object", 5: "no object", 6: "type: question_id", 8: "no object", 9: "type: score"}
    assert bad == {(f"{n}.jsonl", at): (LINES[at - 1], why) for n in "ab" for at, why in reasons.items()}
    lenient, rejects = read_json_lines(spark, str(tmp_path), TYPES, lenient=("score",), rest=None)
    assert lenient.columns == list(TYPES) and lenient.count() == 8 and rejects.count() == 8
    write_rejects(rejects, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 8


def test_places_over_many_parts(spark, tmp_path):
    """A file read in parts of 200 bytes: places are still line numbers."""
    r = random.Random(2)
    lines = [json.dumps({"question_id": i, "question": "x" * r.randint(0, 60)})[: None if i % 7 else -1] for i in range(300)]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        _, rejects = read_json_lines(spark, str(tmp_path), TYPES)
        assert sorted((x["at"], x.raw) for x in rejects.collect()) == [(i + 1, lines[i]) for i in range(0, 300, 7)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('question_id,Query,generation,score\n1,"a ""b""\nc, d",x,1.5\n2,short\n3,,y,\n4,e,f,none\n5,g,h,1,more\n')
    rows, rejects = read_csv(spark, str(tmp_path), {"question_id": "bigint", "score": "double", "absent": "int"})
    assert rows.columns == ["question_id", "question", "answer", "score"]
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, 'a "b"\nc, d', "x", 1.5), (3, None, "y", None)]
    assert sorted((r["at"], r.reason) for r in rejects.collect()) == [(2, "fields"), (4, "type: score"), (5, "fields")]
    assert {r["at"]: r.raw for r in rejects.collect()}[5] == "5,g,h,1,more"


def test_round_trip(spark, tmp_path):
    rows = [(1, 'q "x", y\nz', "2.5"), (2, "", None), (3, "é", "1")]
    df = spark.createDataFrame(rows, "question_id long, question string, score string")
    ingest.write_results(df, f"{tmp_path}/csv", "csv")
    ingest.write_results(df, f"{tmp_path}/json", "json")
    for got, bad in (read_csv(spark, f"{tmp_path}/csv", {"question_id": "bigint", "score": "double"}), read_json_lines(spark, f"{tmp_path}/json", TYPES)):
        found = {r.question_id: (r.question or "", r.score) for r in got.select("question_id", "question", "score").collect()}
        assert found == {1: ('q "x", y\nz', 2.5), 2: ("", None), 3: ("é", 1.0)} and bad.count() == 0


def test_empty_files(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("")
    (tmp_path / "g.csv").write_text("question,score\n")
    assert [x.count() for x in read_json_lines(spark, f"{tmp_path}/f.jsonl", TYPES)] == [0, 0]
    assert [x.count() for x in read_csv(spark, f"{tmp_path}/g.csv", {"score": "int"})] == [0, 0]


VALUES = [
    '[{"a": 1, "a": 2}]', "[NaN]", "[1, null, \"s\", {\"_id\": 1}]", '[[[[[[{"_id": 1, "b": null, "c": 2}]]]]]]', '[{"n": {"_id": 1, "z": null}}]', '[{"t": "say \\":null, and \\"_id\\":"}]',
    "[{'a': (1, 2)}]", "{'a': 1}", "[{'a': None, 'b': [None, {'_rev': 1}]}]", "[]", "3", "null", "[{]", "x" * 50, '[{"k": [{"_key": 1, "q": [{"embedding": [], "ok": true}]}]}]', None, "  ",
]


def test_raw_results_against_python(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, kg_results string")
    got = {r.i: r for r in ingest.parse_kg_results(df).select("i", F.transform("docs", lambda v: F.to_json(v)).alias("docs"), "parsed").collect()}
    for i, value in enumerate(VALUES):
        want = "[]" if value is None or not value.strip() else ingest._parsed(value.strip())
        assert got[i].parsed == (want is not None), value
        if value != "[NaN]":  # no value of a variant
            assert [json.loads(d) for d in got[i].docs] == json.loads(want or "[]"), value


def test_only_failed_rows_reach_python(spark):
    df = spark.createDataFrame([(1, "[]")], "i int, kg_results string")
    plan = ingest.parse_kg_results(df)._jdf.queryExecution().optimizedPlan().toString()
    python = plan[plan.index("ArrowEvalPython") :]
    assert plan.count("ArrowEvalPython") == 1 and "Filter" in python.split("\n")[1] + python.split("\n")[2]
