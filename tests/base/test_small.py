"""Functions that no query goes through, each on a small case."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import audit, conversation, grade, rules, samples, tools
from corpusloom.sources import files
from corpusloom.streaming import ingest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_file_digests_against_a_manifest(spark, tmp_path):
    for name, body in (("a.json", "1"), ("b.json", "22"), ("c.txt", "3")):
        (tmp_path / name).write_text(body)
    got = files.file_digests(spark, str(tmp_path), "*.json")
    at = {r.path.rsplit("/", 1)[-1]: (r.sha256, r.n_bytes) for r in got.collect()}
    assert at == {"a.json": (sha("1"), 1), "b.json": (sha("22"), 2)}
    paths = {r.path.rsplit("/", 1)[-1]: r.path for r in got.collect()}
    wanted = spark.createDataFrame([(paths["a.json"], sha("1")), (paths["b.json"], sha("2")), ("gone", sha("x"))], "path string, sha256 string")
    assert {(r.path.rsplit("/", 1)[-1], r.found) for r in files.verified(wanted, got).collect()} == {("b.json", sha("22")), ("gone", None)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s1", "train", "k1", sha("a"), "x"), ("s2", "dev", "k2", sha("b"), "x"), ("s3", "train", "k1", sha("c"), "y")], "id string, split string, kind string, sha256 string, source string")
    files.write_samples(df, str(tmp_path / "samples"))
    assert {r.id for r in spark.read.json(str(tmp_path / "samples")).where("split = 'train'").collect()} == {"s1", "s3"}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_samples(df, str(tmp_path / "samples"))
    header = {r.split: (r.n, r.k1, r.k2, r.k3, r.digest) for r in files.write_manifest(df, str(tmp_path / "m"), "id", ["k1", "k2", "k3"]).collect()}
    digest = sha(sha("a") + sha("b") + sha("c"))
    assert header == {"train": (2, 2, 0, 0, digest), "dev": (1, 0, 1, 0, digest)}
    by_source = files.write_manifest(df, str(tmp_path / "n"), "id", ["k1"], digest="source").first().digest
    assert by_source == sha("".join(f"{sha(a)}\0{s}\0" for a, s in (("a", "x"), ("b", "x"), ("c", "y"))))
    files.write_csv(df.orderBy("id"), str(tmp_path / "csv"), ["kind", "id"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("id").collect()] == [("k1", "s1"), ("k2", "s2"), ("k1", "s3")]


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("# a run\n---\nseed: 3\nname: 'x # y'\nrate: 0.5  # slow\non: yes\nnone: ~\nlist: [1, 2]\n")
    assert files.load_settings(str(path)) == {"seed": 3, "name": "x # y", "rate": 0.5, "on": True, "none": None, "list": [1, 2]}
    for bad in ("model:\n  size: 3\n", "a: 1\n- b\n", "a: |\n  text\n", "just words\n"):
        path.write_text(bad)
        with pytest.raises(ValueError, match="line"):
            files.load_settings(str(path))
    path.write_text('{"model": {"size": 3}}')
    assert files.load_settings(str(path)) == {"model": {"size": 3}}
    assert files.settings({"a": None, "b": 2}, {"a": 1, "b": 1}, {"c": 0}) == {"a": 1, "b": 2, "c": 0}


def test_only_missing_paths_count_as_new(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert files.new_only(df, spark, str(tmp_path / "none"), "k").count() == 2
    df.where("k = 1").write.parquet(str(tmp_path / "some"))
    assert [r.k for r in files.new_only(df, spark, str(tmp_path / "some"), "k").collect()] == [2]
    with pytest.raises(Exception, match="other"):
        files.new_only(df, spark, str(tmp_path / "some"), "other").collect()


def test_samples_and_their_transcripts(spark):
    a = spark.createDataFrame([("s1", 1), ("s2", 2)], "id string, x int")
    b = spark.createDataFrame([("s2", "t"), ("s3", "t")], "id string, t string")
    both, missing = grade.matched(a, b, "id")
    assert [r.id for r in both.collect()] == ["s2"] and [r.id for r in missing.collect()] == ["s1"]
    assert grade.require_overlap(both) is both
    with pytest.raises(ValueError):
        grade.require_overlap(both.where("false"))
    kind = "sample_id string, call_id string, name string, arguments string"
    declared = spark.createDataFrame([("s", "1", "f", "{}"), ("s", "2", "f", "{}"), ("s", "3", "f", None)], kind)
    issued = spark.createDataFrame([("s", "1", "f", "{}"), ("s", "2", "g", "x"), ("s", "3", "f", "{}"), ("s", "4", "f", "{}"), ("t", "1", "f", "{}")], kind)
    assert {(r.sample_id, r.call_id, r.fault) for r in conversation.mismatched_calls(declared, issued).collect()} == {("s", "2", "name"), ("s", "3", "arguments"), ("s", "4", "unknown_id"), ("t", "1", "unknown_id")}
    made = samples.generate(spark, 3).select("sample_id", samples.result_summary(F.col("expected_tool_calls")).alias("s"))
    assert [r.s for r in made.orderBy("sample_id").collect()] == ["", "calculate = 5", "weather = Lisbon: clear, 21 degrees; search = one result for tides"]


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    texts = spark.createDataFrame([('so {"a": {"b": 1}} is {"c": 2} it',), ('say {"a": 1} done',), ("{broken",), (None,)], "t string")
    assert [r.x for r in texts.select(F.to_json(X.last_json_object(F.col("t"))).alias("x")).collect()] == [None, '{"a":1}', None, None]
    assert one(audit.plain_path(F.lit(' "a\\b/c" '))) == "a/b/c"
    docs = spark.createDataFrame([("docs/a",), ("docs/licenses/x",), ("docs/archive/y",)], "p string")
    assert [r.p for r in audit.included(docs, "p", ("docs/licenses/", "docs/archive/")).collect()] == ["docs/a"]
    assert sorted(one(audit.expand_braces(F.lit("a{b,c{d,e}}")))) == ["ab", "acd", "ace"]


def test_split_at_specials(spark):
    texts = ["a<|end|>b", "<|end|><|e|>x", "\u0002kept\u0002<|e|>\n", "", None, "x" * 200_000 + "<|e|>", "<|en"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.split_specials(F.col("t"), ["<|e|>", "<|end|>"]).alias("p")).collect()
    assert {r.i: r.p for r in rows} == {0: ["a", "<|end|>", "b"], 1: ["<|end|>", "<|e|>", "x"], 2: ["\u0002kept\u0002", "<|e|>", "\n"], 3: [], 4: None, 5: ["x" * 200_000, "<|e|>"], 6: ["<|en"]}


def test_schemas_by_row(spark):
    schema = {"type": "object", "required": ["a"]}
    rows = spark.createDataFrame([("{}", json.dumps(schema)), ('{"a": 1}', '{"required": ["b"]}'), ("[", "{}"), (None, "{}"), ("{}", "no")], "t string, s string")
    assert [r.x for r in rows.select(rules.schema_errors(F.col("t"), schema).alias("x")).collect()] == [["$.a: required"], [], ["$: json"], ["$: json"], ["$.a: required"]]
    assert [r.x for r in rows.select(rules.errors_by_own_schema(F.col("t"), F.col("s")).alias("x")).collect()] == [["$.a: required"], ["$.b: required"], ["$: json"], ["$: json"], ["$: json"]]


def test_tools_as_sql_functions(spark):
    tools.registered(spark, tools.example_tools())
    got = json.loads(spark.sql("""select tool_add('{"a": 1, "b": 2}') as x""").first().x)
    assert (got["outcome"], got["result"]) == ("success", 3)
    got = tools.example_tools().call("translate", {"text": "hi", "target": "de"})
    assert got["outcome"] == "success" and got["result"].startswith("ERROR: ")
    assert tools.example_tools().call("translate", {"text": ""})["outcome"] == "argument_invalid"


def test_schema_layer_sees_arguments_as_they_are():
    offered = [{"function": {"name": "f", "parameters": {"type": "object"}}}]
    layer = lambda call: tools.grade_transcript({"tools": offered}, {"tool_calls": [call]})["schema_valid"]
    assert layer({"name": "f", "arguments": {}}) is True and layer({"name": "f"}) is True
    assert [layer({"name": "f", "arguments": x}) for x in ([1], 5, None, '{"a": 1}')] == [False] * 4
    assert layer({"name": "g", "arguments": 5}) is None


def test_prompt_keeps_a_last_answer_with_calls(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s", 0), (1, 1, "user", "u", 0), (1, 2, "assistant", "a", 0), (2, 0, "user", "u", 0), (2, 1, "assistant", "calls", 1)], "conv_id long, turn int, role string, text string, n int")
    got = dict(map(tuple, conversation.render_prompt(turns, F.col("n") > 0).collect()))
    assert got == {1: "### User\nu\n\n### Assistant\n", 2: "### User\nu\n\n### Assistant\ncalls\n\n### Assistant\n"}


def test_live_counts_leave_late_rows_out(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda *x: spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", k, v) for m, k, v in x], "ts string, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "event_type", "value").coalesce(1)
    for batch in (row((1, "a", 1.0), (2, "a", 2.0), (2, "b", 5.0)), row((40, "a", 3.0)), row((3, "a", 9.0), (41, "a", 1.0)), row((59, "b", 1.0))):
        batch.write.mode("append").parquet(src)
        stream = ingest.live_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    got = {(str(r.start), r.event_type): (r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01 00:00:00", "a"): (2, 3.0), ("2024-01-01 00:00:00", "b"): (1, 5.0), ("2024-01-01 00:40:00", "a"): (2, 4.0)}
