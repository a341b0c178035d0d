"""What a task holds has a bound: plans whose aggregates come behind the shuffle, and batches that are cut by size."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compare, runs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_neither_multiplies_rows_nor_sorts_them(spark):
    from corpusloom.plans import load_all

    rows = spark.createDataFrame([(1, 12), (1, 31), (2, 20), (3, None), (4, None), (4, 40)], "k int, size int")
    got = compare.nearest(rows, ["k"], "width", [("c", 32), ("a", 8), ("b", 16)], F.col("size"))
    assert dict(map(tuple, got.collect())) == {1: "c", 2: "b", 3: "a", 4: "c"}
    found = plan(load_all()[0]["nearest_width"](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in found and "NestedLoop" not in found


def test_figures_of_steps_are_made_behind_the_shuffle(spark):
    kind = "run string, step long, skipped boolean, tokens_seen long, loss double, injected boolean, rollouts array<struct<reward: double, advantage: double, n_calls: int, generated: string>>"
    row = lambda step, *rollouts: ("a", step, False, 1, 1.0, False, [(*r, 0, "x") for r in rollouts])
    made = spark.createDataFrame([row(0, (0.0, 0.5), (1.0, 0.5)), row(1, (0.5, 0.5), (0.5, 0.5)), row(2, (0.0, -0.5), (1.0, 0.5)), row(3)], kind)
    found = runs.reward_violations(made, [])
    assert [tuple(r) for r in found.collect()] == [("a", 0, "advantage_mean")]
    above, below = plan(found).split("Generate explode(rollouts", 1)
    assert "Exchange hashpartitioning(run" in below
    assert above.count("HashAggregate") == 2  # no step more for different rewards


def test_batches_of_pretokens_are_coded_by_slices(monkeypatch):
    import pyarrow as pa

    from corpusloom.operators import bpe

    model = bpe.Tokenizer(bpe.learn_merges({b"abab": 3, b"abc": 2, b"xyz": 1}, 262))
    monkeypatch.setattr(bpe, "SLICE", 4)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    rows = pa.array([["abab", "abc"], None, [], ["x"] * 9, ["abc", "xyz", "é"], ["abab"]], pa.list_(pa.string())).slice(1)
    assert list(bpe._slices(rows)) == [(0, 2), (2, 3), (3, 5)]
    known = bpe._Known(model)
    got = [x for a, b in bpe._slices(rows) for x in known.coded(rows.slice(a, b - a)).to_pylist()]
    assert got == [None if ws is None else [i for w in ws for i in model.encode_word(w)] for ws in rows.to_pylist()]
    assert len(known.number) <= 4  # those of the last slice


def test_the_gate_parses_a_text_once(spark):
    from corpusloom.operators import gate
    from corpusloom.plans.gates import SCHEMA

    rows = spark.createDataFrame([('{"k": 12, "who": "view"}',), ('{"k": 1}',), ("{",), (None,)], "body string").select(gate.compiled(SCHEMA)(F.col("body")).alias("e"))
    assert [r.e for r in rows.collect()] == [[], ["$.who: required", "$.k: minimum"], ["$: json"], ["$: json"]]
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_the_member_that_samples_begin_with_is_parsed_once(monkeypatch):
    import json

    from corpusloom.operators import tools

    many = [f'{{"tools": [{{"name": "f"}}], "expected_answer": {i}}}' for i in range(50)]
    odd = ['{"tools": [{"name": "f"}]}', '{"tools": [{"name": "f"}], }', '{"tools": [{"name": "f"}],, "a": 1}', '{"tools": [{"name": "f"}] "a": 1}', '{"tools": [{"name": "f"}], "tools": 2}', '{"tools": [{"name": "f"}], "a": 1} x', '{"tools": [{"name": "f"}], "a": [1]',
           '{"a": 1, "b": 2}', '{"a": 12, "b": 2}', '{"a": {"x": 1}, "b": 2}', ' {"a":{"x": 1} , "b": 3}\n', '{"a": {"x": 1}x', "[1]", "", None, "null", '{"a\\u0062": [1], "c": 2}', '{"b": [1', '{"b": [1], "c": 2}', '{"b": [1],\x0c"c": 2}', '{"b": [1]\xa0, "c": 2}']
    known = tools._Objects()
    texts = [*many, *(x for o in odd for x in (o, o, many[0]))]
    assert [known.of(x) for x in texts] == [tools._object(x) for x in texts]
    sizes, loads = [], json.loads
    monkeypatch.setattr(tools.json, "loads", lambda t: sizes.append(len(t)) or loads(t))
    known = tools._Objects()
    assert [known.of(x)["expected_answer"] for x in many] == list(range(50)) and max(sizes[1:]) < 30
