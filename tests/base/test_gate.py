"""Compiled schemas against the interpreter on random documents; gated writes; guards of samples."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import gate
from corpusloom.operators.rules import check

SCHEMAS = [
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0, "exclusiveMinimum": -1, "maximum": 5}, "b": {"type": ["string", "null"], "minLength": 2, "pattern": "^x"}}, "additionalProperties": False},
    {"type": "object", "properties": {"a": {"enum": [1, "x", None, [1], {"k": 1}]}, "b": {"const": {"k": [1, 2]}}}, "additionalProperties": {"type": "number"}, "propertyNames": {"pattern": "^[a-c]$"}},
    {"type": ["array", "object"], "minItems": 2, "uniqueItems": True, "items": {"type": ["integer", "string", "object"], "properties": {"a": {"type": "boolean"}}, "required": ["a"]}, "contains": {"type": "integer", "minimum": 2}},
    {"$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"a": {"$ref": "#/$defs/u"}, "b": False}}, "u": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}}},
    {"minimum": 3},
    True,
    False,
    {"type": "string", "format": "date-time"},
]


def value(rng, depth=0):
    kind = rng.choice("ioosdbnla" if depth < 3 else "isbn")
    if kind == "i":
        return rng.randrange(-3, 9)
    if kind == "d":
        return rng.choice([1.5, 2.25, -0.5])
    if kind == "s":
        return rng.choice(["", "x", "xy", "zz", "ü\"\\", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z", "2024-01-02 03:04:05+01:00"])
    if kind == "b":
        return rng.random() < 0.5
    if kind == "n":
        return None
    if kind in "la":
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "c", "dd"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_compiled_equals_the_interpreter(spark):
    rng = random.Random(8)
    docs = [value(rng) for _ in range(700)] + [{"a": 1, "b": "xx"}, {"k": 1}, [2, "a"], {"a": [[1, 2], [3]]}, {"a": [[1, "x"]]}, {"b": {"k": [1, 2]}}]
    texts = [json.dumps(d) for d in docs] + ["{broken", "", None, "{} {}", "1 2", "[1]]", "1,2] x", "1] [", "{}, {}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    for schema in SCHEMAS:
        got = {r.i: sorted(r.e) for r in rows.select("i", gate.compiled(schema)(F.col("text")).alias("e")).collect()}
        for i, d in enumerate(docs):
            assert got[i] == sorted(check(schema, d)), (schema, d)
        assert all(got[i] == ["$: json"] for i in range(len(docs), len(texts)))


def test_what_cannot_be_compiled(spark):
    for schema in ({"oneOf": []}, {"properties": {"a": {"$ref": "#"}}, "$ref": "#/$defs/t", "$defs": {"t": {"properties": {"a": {"$ref": "#/$defs/t"}}}}}):
        with pytest.raises((ValueError, KeyError)):
            gate.compiled(schema)(F.col("text"))


def test_gated_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "[1]"), (2, "3"), (3, "x"), (4, None)], "i int, text string")
    rule = gate.compiled({"type": "array"})(F.col("text"))
    with pytest.raises(ValueError, match="3 of 4 rows"):
        gate.gated_write(df, rule, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
    assert gate.gated_write(df, rule, str(tmp_path / "out"), most_rejected=3) == {"accepted": 1, "quarantine": 3}
    back = {r.i: (r.part, r.errors) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {1: ("accepted", []), 2: ("quarantine", ["$: type"]), 3: ("quarantine", ["$: json"]), 4: ("quarantine", ["$: json"])}
    with pytest.raises(FileExistsError):
        gate.gated_write(df, rule, str(tmp_path / "out"), most_rejected=None)
    assert gate.gated_write(df.where("i = 1"), rule, str(tmp_path / "good")) == {"accepted": 1, "quarantine": 0}


def test_results_and_guards(spark):
    calls = spark.createDataFrame([("s1", "add", '{"a": 1, "b": 2}', None), ("s1", "add", '{"b":2,"a":1}', "kept"), ("s2", "sub", "{}", None), ("s3", "nil", "{}", None)], "sample_id string, name string, arguments string, expected_result string")
    results = spark.createDataFrame([("add", '{"b": 2, "a": 1}', "3"), ("nil", "{}", None)], "name string, arguments string, result string")
    filled = gate.with_results(calls, results)
    assert sorted((r.sample_id, str(r.expected_result), r.executable) for r in filled.collect()) == [("s1", "3", True), ("s1", "kept", True), ("s2", "None", False), ("s3", "None", True)]
    samples = spark.createDataFrame([("s1", "multi"), ("s2", "no_tool"), ("s3", "single"), ("s4", "single"), ("s5", "no_tool")], "sample_id string, class string")
    assert {r.sample_id: r.errors for r in gate.sample_guards(samples, filled).collect()} == {"s1": [], "s2": ["no_tool: calls", "call: not executable"], "s3": ["call: no result"], "s4": ["calls: none"], "s5": []}
