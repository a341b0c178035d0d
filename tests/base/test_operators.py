import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numeric, text
from corpusloom.operators import audit, bpe, compare, conversation, corpus, grade, rules, samples, splits, tools, windows
from corpusloom.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pretokens_match_regex(spark):
    import regex

    p = regex.compile(text.PRETOKEN.removeprefix("(?U)"))
    cases = ["a\n\n\nb", "it's  we'll x 12 éa!! ", "", " \t x", "日本 語。a\x85b"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", text.pretokens(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in got] == [p.findall(c) for c in cases]


def test_specials(spark):
    df = spark.createDataFrame([("a!<|x|>b <|xy|>",)], "t string")
    assert df.select(text.special_pretokens(F.col("t"), ["<|x|>", "<|xy|>"])).first()[0] == ["a", "!", "<|x|>", "b", " ", "<|xy|>"]
    assert df.select(text.special_pretokens(F.col("t"), ["<|x|>", "<|xy|>"], keep=False)).first()[0] == ["a", "!", "b", " "]


def test_arguments(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{x",), (None,)], "t string")
    assert [json.loads(r[0]) for r in df.select(text.arguments(F.col("t"))).collect()] == [{"a": 1}, {}, {}, {}]


def test_windows_golden(spark):
    stream = spark.range(25).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.col("id").alias("tok"))
    got = windows.causal_windows(stream, ["k"], "pos", "tok", 4, 2).orderBy("window").collect()
    assert len(got) == 6
    assert (got[0].inputs, got[1].inputs, got[0].targets) == ([0, 1, 2, 3], [4, 5, 6, 7], [1, 2, 3, 4])
    assert got[4].inputs[-1] == 19
    with pytest.raises(ValueError):
        windows.check_shape(1, 5, 5)
    n = spark.range(1).select(windows.scored_tokens(F.lit(68_003_129), 1024)).first()[0]
    assert n == 67_936_719


def test_advantages(spark):
    df = spark.createDataFrame([(1, 0.333)] * 15 + [(1, 0.143)] + [(2, 0.875)] * 2, "g int, r double")
    got = Counter((r.g, round(r.advantage, 3)) for r in windows.group_advantage(df, "g", "r").collect())
    assert got == {(1, 0.258): 15, (1, -3.873): 1, (2, 0.0): 2}


def test_byte_prefix_and_lines(spark):
    docs = spark.createDataFrame([(i, "é" * i + "\r\n\nx") for i in range(3000)], "doc_id long, text string")
    want, total = 0, 0
    for i in range(3000):
        total += 2 * i + 4
        want += total <= 90_000
    assert corpus.byte_prefix(docs, 90_000).count() == want
    assert [r.line for r in corpus.line_table(docs.where("doc_id = 1")).orderBy("line_no").collect()] == ["é\r\n", "\n", "x"]


def brute_merges(words, n):
    split = {w: [bytes([b]) for b in w] for w in words}
    out = []
    for _ in range(n):
        counts = Counter()
        for w, parts in split.items():
            for p in set(zip(parts, parts[1:])):
                counts[p] += words[w]
        if not counts:
            break
        best = max(counts, key=lambda p: (counts[p], p))
        out.append(best)
        split = {w: joined(p, best) for w, p in split.items()}
    return out


def joined(parts, pair):
    """Every occurrence of a pair as one part, from left to right, by way of a stack."""
    out = []
    for x in parts:
        if out and (out[-1], x) == (pair[0], pair[1]) and not isinstance(out[-1], bytearray):
            out[-1] = bytearray(out[-1] + x)  # made just now, so that it takes no part in this merge
        else:
            out.append(x)
    return [bytes(x) for x in out]


def test_bpe_agrees_with_brute_force():
    rng = random.Random(4)
    words = {bytes(rng.choices(b"abcd", k=rng.randrange(1, 9))): rng.randrange(1, 9) for _ in range(200)}
    assert bpe.learn_merges(words, 256 + 60) == brute_merges(words, 60)
    with pytest.raises(ValueError):
        bpe.learn_merges({}, 256, 1)


def test_bpe_training_holds_little_beside_the_words():
    import tracemalloc

    words = {f"{i * 7919 % 1000003:x}{i:x}".encode(): 1 + i % 5 for i in range(300_000)}
    tracemalloc.start()
    try:
        merges = bpe.learn_merges(words, 256 + 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(merges) == 3
    assert peak < 40 * sum(map(len, words))


def test_bpe_encodes_by_least_rank():
    rng = random.Random(6)
    words = {bytes(rng.choices(b"aabc", k=rng.randrange(1, 12))): rng.randrange(1, 9) for _ in range(150)}
    model = bpe.Tokenizer(bpe.learn_merges(words, 256 + 70), ["<|x|>"])
    rank = {p: i for i, p in reversed(list(enumerate(model.merges)))}
    texts = ["".join(rng.choices("aabcé", k=rng.randrange(0, 30))) for _ in range(300)] + ["<|x|>", "a" * 200]
    for text, ids in zip(texts, model.encode_words(texts), strict=True):
        parts = [bytes([b]) for b in text.encode()]
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert ids == ([0] if text == "<|x|>" else [model.ids[p] for p in parts])
    assert model.encode_words([]) == []


def test_bpe_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Once upon a time, a small model learned. Once upon a time, a tool was called. <|end|>"), (2, "βeta \r\n"), (3, None)], "doc_id long, text string")
    model = bpe.train(docs, 280, ["<|end|>"])
    assert len(model.tokens) <= 280
    coded = bpe.encode(docs, model)
    back = dict(map(tuple, bpe.decode(coded, model).collect()))
    assert back == {1: docs.first().text, 2: "βeta \r\n", 3: None}
    assert coded.where("doc_id = 1").first().ids.count(0) == 1
    path = str(tmp_path / "t.json")
    model.save(path)
    assert bpe.Tokenizer.load(path).tokens == model.tokens
    body = json.load(open(path))
    body["merges"].pop()
    json.dump(body, open(path, "w"))
    with pytest.raises(ValueError):
        bpe.Tokenizer.load(path)


def test_splits(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("c"))
    out = splits.stratified_split(df, "id", "c", 1)
    assert rows(out.groupBy("c", "split").count()) == [(c, s, n) for c, t in ((0, 334), (1, 333), (2, 333)) for s, n in (("dev", 50), ("test", 50), ("train", t - 100))]
    assert splits.class_plan(8, ["a", "b", "c"]) == [("a", 3), ("b", 3), ("c", 2)]


def test_digests(spark):
    import hashlib

    df = spark.createDataFrame([(2, "b", "s"), (1, "a", "r")], "doc_id long, sha256 string, source string")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert splits.digest_contents(df).first()[0] == h("ab")
    assert splits.digest_sources(df, "source").first()[0] == h("a\0r\0b\0s\0")
    assert splits.digest_ids(df).first()[0] == h("1\n2\n")


def test_strip_modes_differ(spark):
    turns = spark.createDataFrame([(1, i, r, r[0]) for i, r in enumerate(["system", "user", "assistant", "assistant"])], "conv_id int, turn int, role string, text string")
    assert conversation.without_last_answers(turns).count() == 2
    assert conversation.without_last_answer(turns).count() == 3
    assert conversation.render_prompt(turns).first().prompt == "### User\nu\n\n### Assistant\na\n\n### Assistant\n"


def test_dependencies(spark):
    calls = spark.createDataFrame([("s", "a", 0, ["a"]), ("s", "b", 1, ["c", "z"]), ("s", "c", 2, ["b"]), ("s", "c", 3, [])], "sample_id string, call_id string, pos int, depends_on array<string>")
    assert Counter(r.fault for r in conversation.dependency_faults(calls).collect()) == {"self": 1, "not_earlier": 1, "dangling": 1, "duplicate_id": 1}


def test_three_valued_layers(spark):
    df = spark.createDataFrame([(True, None, False), (None, None, None), (True, None, True), (False, None, None)], "a boolean, b boolean, c boolean")
    got = grade.graded(df.toDF(*grade.LAYERS[:3]).withColumns({x: F.lit(None).cast("boolean") for x in grade.LAYERS[3:]})).select("first_failure", "reward_binary", "reward_layered").collect()
    assert [tuple(r) for r in got] == [("tool_name_correct", 0.0, 0.5), (None, 0.0, 0.0), (None, 1.0, 1.0), ("parse_success", 0.0, 0.0)]


SAMPLE = {
    "tools": [{"type": "function", "function": {"name": n, "description": "d", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}} for n in "fg"],
    "expected_tool_calls": [{"call_id": "1", "name": "f", "arguments": {"a": 1}, "expected_result": 5}, {"call_id": "2", "name": "g", "arguments": {"a": 2}, "depends_on": ["1"]}],
    "expected_answer": "five",
}
DONE = {"execution_outcome": "success"}
GOOD = [{"call_id": "1", "name": "f", "arguments": {"a": 1}, "result": 5} | DONE, {"call_id": "2", "name": "g", "arguments": {"a": 2}, "depends_on": ["1"]} | DONE]


@pytest.mark.parametrize(
    "calls, answer, want",
    [
        (GOOD, "it is five", [True] * 8),
        (GOOD[::-1], "five", [True, True, True, True, False, True, False, True]),
        ([GOOD[0] | {"name": "h"}, GOOD[1]], "five", [True, None, False, False, False, True, True, True]),
        ([GOOD[0] | {"arguments": {"a": "x"}}, GOOD[1]], "", [True, False, True, False, False, True, True, False]),
        ([GOOD[0] | {"arguments": {"a": 1.0}}, GOOD[1]], "five", [True, True, True, False, True, True, True, True]),
        ([], "five", [True, True, False, False, False, None, None, True]),
        (None, "five", [False, *[None] * 6, True]),
        ([None, GOOD[0]], "no", [False, *[None] * 6, False]),
    ],
)
def test_grader(calls, answer, want):
    assert list(tools.grade_transcript(SAMPLE, {"tool_calls": calls, "final_answer": answer}).values()) == want


def test_grader_without_calls():
    none = {"tools": [], "expected_tool_calls": [], "expected_answer": None}
    assert list(tools.grade_transcript(none, {"tool_calls": []}).values()) == [True, True, True, True, True, True, True, None]
    assert tools.grade_transcript(none, {"tool_calls": [GOOD[0]]})["result_grounded"] is True
    assert tools.grade_transcript(none, {})["parse_success"] is False


def test_executor():
    run = tools.example_tools().run
    out = run([{"call_id": "1", "name": "add", "arguments": {"a": 2, "b": 3}}, {"call_id": "2", "name": "multiply", "arguments": {"a": 5, "b": 4}, "depends_on": ["1"]}])
    assert [r["result"] for r in out] == [5, 20]
    out = run([{"call_id": "1", "name": "nope"}, {"call_id": "2", "name": "add", "arguments": {"a": "x", "b": 1}}, {"call_id": "3", "name": "divide", "arguments": {"a": 1, "b": 0}}, {"call_id": "4", "name": "add", "arguments": {"a": 1, "b": 1}, "depends_on": ["3"]}])
    assert [r["outcome"] for r in out] == ["mock_not_found", "argument_invalid", "mock_exception", "skipped"]
    assert "did not complete" in out[3]["error"]
    assert len(run([{"call_id": "1", "name": "add", "depends_on": ["2"]}, {"call_id": "2", "name": "add", "depends_on": ["1"]}])) == 2


def test_calculate():
    assert [tools.calculate(x) for x in ("2^3 + 1", "7 / 2", "-(4 - 6) * 3")] == [9, 4, 6]
    for bad in ("__import__('os')", "9^9^9^9", "a + 1"):
        with pytest.raises((ValueError, SyntaxError)):
            tools.calculate(bad)


def test_extract():
    plan = '{"name": "f", "arguments": "{\\"a\\": 1}", "depends_on": ["x"]} and {"name": "g }{"}'
    assert [c["name"] for c in tools.extract_calls(plan)] == ["f", "g }{"]
    assert tools.extract_calls(plan)[0]["arguments"] == {"a": 1}
    assert tools.extract_calls(plan, legacy_array_first=True) == []
    assert tools.extract_calls("text only") is None
    assert [c["name"] for c in tools.extract_calls('```json\n[{"name": "f"}, {"name": "g"}]\n```')] == ["f", "g"]


def test_schema_subset():
    schema = {"type": "object", "required": ["a", "t"], "additionalProperties": False, "properties": {"a": {"$ref": "#/$defs/n"}, "t": {"type": "string", "format": "date-time"}, "l": {"type": "array", "uniqueItems": True, "minItems": 1, "items": {"enum": [1, "x", None]}}}, "$defs": {"n": {"type": ["integer", "null"], "minimum": 0, "exclusiveMinimum": -1}}}
    ok = {"a": 1, "t": "2026-01-02T03:04:05Z", "l": [1, "x", None]}
    assert rules.check(schema, ok, strict=True) == []
    assert rules.check(schema, ok | {"a": True}) == ["$.a: type"]
    assert rules.check(schema, {"a": -5, "t": "soon", "l": [1, 1, 2], "z": 0}) == ["$.a: minimum", "$.a: exclusiveMinimum", "$.t: format", "$.l: uniqueItems", "$.l[2]: enum", "$.z: additionalProperties"]
    assert rules.check(schema, {}) == ["$.a: required", "$.t: required"]
    assert rules.check({"const": 1}, True) == ["$: const"]
    with pytest.raises(ValueError):
        rules.check({"oneOf": []}, 1, strict=True)


def test_samples_execute_to_their_results(spark):
    made = samples.generate(spark, 120)
    for r in made.collect():
        calls = [c.asDict() | {"arguments": json.loads(c.arguments)} for c in r.expected_tool_calls]
        assert [str(x["result"]) for x in tools.example_tools().run(calls)] == [c["expected_result"] for c in calls]
    more = samples.augmented(made, 2)
    assert more.select("sample_id").distinct().count() == more.count() > made.count()
    for r in more.where("task_type = 'single_tool'").collect():
        assert tools.calculate(r.question.removeprefix("What is ")) == int(r.expected_answer)


def test_training_examples(spark):
    df = spark.createDataFrame([([1, 2], [3, 4], 1), ([1, 2, 3, 4, 5], [6], 1)], "p array<int>, b array<int>, k int")
    out = df.select("k", *samples.training_example(F.col("p"), F.col("b"), 0, 4))
    assert rows(out) == [(1, [1, 2, 3, 4], [2, 3, 4, 0], [0, 1, 1, 1]), (1, [1, 2, 3, 4], [2, 3, 4, 5], [0, 0, 0, 0])]
    assert samples.learnable(out).count() == 1
    assert {len(r.x) for r in samples.padded(spark.createDataFrame([(1, [1]), (1, [1, 2, 3])], "k int, x array<int>"), "k", "x", 0).collect()} == {3}


def test_compare(spark):
    points = spark.createDataFrame([("c", 10, 2.0, 1), ("c", 5, 1.0, 2), ("c", 20, 1.0, 3), ("c", 1, float("nan"), 0), ("c", 7, 4.0, 4)], "k string, step int, loss double, pos int")
    r = compare.curve_summary(points, ["k"], "step", "loss", "pos").first()
    assert (r.first, r.last, r.least, r.least_step, r.n) == (2.0, 4.0, 1.0, 5, 4)
    layers = spark.createDataFrame([([59, 52, 66, 79], 17), ([48, 62, 71, 75], 18)], "a array<long>, d long")
    r = compare.routing_totals(layers, [], "a", "d", 256).first()
    assert (r.assigned, r.dropped, r.dropped_of_layer, r.dropped_of_all) == (512, 35, 35 / 256, 35 / 512)


def test_references(spark):
    assert audit.expanded("a/{b,c{1,2}}.md") == ["a/b.md", "a/c1.md", "a/c2.md"]
    refs = spark.createDataFrame([("a/b.md",), ("a/*.py",), ("a/c",), ("zz",)], "ref string")
    paths = spark.createDataFrame([("a/b.md",), ("a/x.py",), ("a/c.json",)], "path string")
    got = dict(map(tuple, audit.resolved(refs, paths, [".md", ".json"]).select("ref", "status").collect()))
    assert got == {"a/b.md": "exact", "a/*.py": "glob", "a/c": "extension", "zz": "missing"}
    docs = spark.createDataFrame([(1, "x\npython -m a.b \\\n --c\n python3 s/t.py")], "k int, t string")
    assert [r.script for r in audit.invocations(docs, "k", "t").collect()] == ["a.b", "s/t.py"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text('{"id": "x", "v": 1}')
    (tmp_path / "in/two.json").write_text('{"v": 2}')
    docs = files.json_documents(spark, str(tmp_path / "in"))
    assert sorted(r.id for r in docs.collect()) == ["two", "x"]
    (tmp_path / "t.json").write_text(json.dumps({"rows": [{"sample_id": "a", "n": 1}, {"sample_id": "a", "n": 2}, {"sample_id": ""}]}))
    assert [json.loads(r.row)["n"] for r in files.transcripts(spark, str(tmp_path / "t.json")).collect()] == [2]
    coded = spark.createDataFrame([(1, [5, 6]), (2, [7])], "doc_id long, ids array<int>")
    path = str(tmp_path / "cache")
    assert files.write_token_cache(coded, path, "train", "abc").first().token_count == 3
    assert files.read_token_cache(spark, path, "train", "abc").count() == 2
    with pytest.raises(ValueError):
        files.read_token_cache(spark, path, "train", "other")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_token_cache(coded, path, "train", "abc")
    blobs = coded.select("doc_id", files.blob_of(F.col("ids")).alias("b"))
    assert [r[0] for r in blobs.select(files.ints_of(F.col("b"))).collect()] == [[5, 6], [7]]
    assert files.new_only(coded, spark, str(tmp_path / "none"), "doc_id").count() == 2
    assert files.settings({"a": None, "b": 2}, {"a": 1}, {"a": 0, "c": 3}) == {"a": 1, "b": 2, "c": 3}


def test_numeric(spark):
    r = spark.range(1).select(numeric.timestamp_text(0, F.lit(3500)).alias("t"), numeric.capacity(F.lit(256), 4, 1.0).alias("c"), numeric.cosine_rate(F.lit(100), 1.0, 0.1, 10, 100).alias("r"), numeric.rate(F.lit(1), F.lit(0)).alias("z")).first()
    assert (r.t, r.c, round(r.r, 9), r.z) == ("2026-07-25T18:18:20Z", 64, 0.1, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    from corpusloom.streaming import ingest

    src = str(tmp_path / "src")
    docs = spark.createDataFrame([(i, "a b " * i) for i in range(20)], "doc_id long, text string")
    docs.where("doc_id < 10").write.parquet(src)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for more in (None, docs.where("doc_id >= 10")):
        if more is not None:
            more.write.mode("append").parquet(src)
        ingest.drain(ingest.token_counts(ingest.new_files(spark, src, docs.schema)), out, check)
    assert rows(spark.read.parquet(out)) == rows(ingest.token_counts(docs))


def test_contracts(spark):
    from corpusloom.operators import contracts as C

    a = {"id": "x-1", "messages": [{"role": "user", "content": "q"}], "expected_tool_calls": [{"call_id": "1", "name": "f", "arguments": {"b": 1, "a": 2}}], "metadata": {"split": "dev", "created_at_pos": 3, "task_type": "t"}}
    b = json.loads(json.dumps(a)) | {"id": "y-9", "metadata": {"split": "test", "created_at_pos": 8, "task_type": "t"}}
    c = a | {"messages": []}
    got = [tuple(r) for r in spark.createDataFrame([(json.dumps(x),) for x in (a, b, c)] + [("{",)], "j string").select(C.content_signature(F.col("j")), C.comparable_signature(F.col("j"))).collect()]
    assert got[0] == got[1] and got[0][0] != got[2][0] and got[0][1] != got[2][1] and got[3] == (None, None)
    steps = spark.createDataFrame([(1, 0.5, 1.0), (1, 0.1, -1.0), (2, 1.5, 0.5), (2, 0.0, 0.1), (3, 0.5, 1.0), (3, 0.5, -1.0)], "step_id int, reward double, advantage double")
    assert rows(C.run_violations(steps)) == [(2, "advantage_mean"), (2, "reward_bounds"), (3, "no_variance")]
    assert C.settings_differ({"a": 1.0, "b": 2, "c": "x"}, {"a": 1.0 + 1e-12, "b": 3, "d": 1}) == ["b", "c", "d"]
    arts = spark.createDataFrame([("m", "c1", 1, 5, "done"), ("n", "c9", 1, 4, "done")], "artifact string, commit string, seed int, steps int, status string")
    want = spark.createDataFrame([("m", 1, 5, "done"), ("n", 1, 5, "done"), ("o", 1, 5, "done")], "artifact string, seed int, steps int, status string")
    assert rows(C.provenance_violations(arts, want, ["c1"])) == [("n", "commit"), ("n", "steps"), ("o", "missing")]
    made = samples.generate(spark, 60)
    assert C.guarded(made)[1].count() == 0
    assert rows(C.set_violations(made.select(F.col("sample_id").alias("id"), "task_type", F.lit("synthetic").alias("source")), ["no_tool", "other"])) == [("other", "coverage")]


def test_reward_channels(spark):
    from corpusloom.operators import grade

    rows = [(True, None), (True, "final_answer_correct"), (True, "result_grounded"), (True, "schema_valid"), (False, "parse_success"), (None, None), (False, None)]
    out = spark.createDataFrame(rows, "parse_success boolean, first string").select(grade.dominant_reward(F.col("parse_success"), F.col("first")).alias("c")).collect()
    assert [r.c for r in out] == ["execution_correct", "final_answer_correct", "argument_correct", "argument_correct", "parse_success", "parse_success", "parse_success"]


def test_grades_of_odd_input(spark):
    from corpusloom.operators import tools

    call = lambda name: {"name": name, "arguments": {}}
    graded = lambda wanted, got: tools.grade_transcript({"expected_tool_calls": [call(wanted)]}, {"tool_calls": [call(got)]})["tool_name_correct"]
    assert graded("a", "a") and not graded("None", None) and not graded("5", 5)
    assert tools.grade_transcript({"expected_answer": 5}, {"tool_calls": [], "final_answer": "it is 5"})["final_answer_correct"] is True
    samples = spark.createDataFrame([("s", '{"expected_answer": "x"}'), ("t", None)], "sample_id string, sample string")
    rollouts = spark.createDataFrame([("s", 0, '{"tool_calls": [], "final_answer": "x"}'), ("s", 1, "{broken"), ("t", 0, None), ("u", 0, "{}")], "sample_id string, rollout_index int, transcript string")
    got = {(r.sample_id, r.rollout_index): (r.first_failure, r.reward_binary) for r in tools.rollout_rewards(samples, rollouts).collect()}
    assert got == {("s", 0): (None, 1.0), ("s", 1): ("parse_success", 0.0), ("t", 0): ("parse_success", 0.0)}


def test_split_sizes_round_half_to_even(spark):
    from corpusloom.operators import splits

    out = splits.stratified_split(spark.range(30).withColumn("c", F.lit("x")), "id", "c", 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"test": 4, "dev": 4, "train": 22}


def test_first_merge_is_the_best_byte_pair(spark):
    from corpusloom.operators import bpe, corpus

    docs = spark.createDataFrame([(1, "\u00e9\u00e9\u00e9 \u00e9\u00e9 ab"), (2, "abab \u00e8\u00e8"), (3, None), (4, "")], "doc_id long, text string")
    pairs = corpus.pair_counts(corpus.word_table(docs)).collect()
    best = max((r.n, r.left_byte, r.right_byte) for r in pairs)
    left, right = bpe.train(docs, 257).merges[0]
    assert (best[1].lower(), best[2].lower()) == (left.hex(), right.hex())


def test_names_and_batches_that_are_not_there(spark):
    from corpusloom.operators import compare

    models = spark.createDataFrame([("a", "x/a"), ("b", "a")], "short string, full string")
    assert [(r.short, r.pos) for r in compare.resolved_names(models, "short", "full", ["a", "x/a"]).orderBy("pos").collect()] == [("a", 0), ("a", 1)]
    with pytest.raises(ValueError):
        compare.resolved_names(models, "short", "full", ["a", "c"])
    assert compare.named_like(models, "short", None).count() == 2
    with pytest.raises(ValueError):
        compare.first_batches(spark.createDataFrame([], "k int, batch int, loss double"), ["k"], "batch", "loss", 3)


def test_transcripts_keep_nulls_and_fill_absent_columns(spark):
    from corpusloom.operators import grade

    rows = spark.createDataFrame([(1, None)], "id int, generated string")
    assert grade.as_transcripts(rows).first().asDict() == {"id": 1, "tool_calls": [], "final_answer": None}


def test_seed_files(spark, tmp_path):
    from corpusloom.sources import files

    (tmp_path / "eval-1.json").write_text('{"total": 2}')
    (tmp_path / "eval-2.json").write_text('{"total": 3}')
    got = files.seed_files(spark, "eval-*.json", str(tmp_path))
    assert sorted(r.total for r in got.collect()) == [2, 3]
    with pytest.raises(ValueError):
        files.seed_files(spark, str(tmp_path / "none-*.json"))
