"""Queries through byte-pair models, extraction, execution and grading; those without SQL are held against brute force by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bpe, grade, native_grade, samples, tools, windows
from . import query, table

VOCABULARY = 4096


@query()
def bpe_train(spark, sf_dir):
    """The merges of a vocabulary of 4,096, learned from all documents."""
    merges = bpe.train(table(spark, sf_dir, "documents"), VOCABULARY).merges
    return spark.createDataFrame([(i, a.hex(), b.hex()) for i, (a, b) in enumerate(merges)], "rank int, left_hex string, right_hex string")


@query()
def bpe_encode(spark, sf_dir):
    """Documents coded with merges learned from the benchmark."""
    model = bpe.train(table(spark, sf_dir, "benchmark"), 1024)
    coded = bpe.encode(table(spark, sf_dir, "documents"), model)
    return coded.select("doc_id", F.size("ids").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def bpe_round_trip(spark, sf_dir):
    """Documents coded and decoded again: their texts."""
    model = bpe.train(table(spark, sf_dir, "benchmark"), 1024)
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '[{"name": "f' || (turn % 3) || '", "arguments": {"conv": ' || conv_id || ', "deep": {"x": [1, "}"]}}}' || CASE WHEN turn % 2 = 1 THEN ', {"name": "g", "arguments": {}}' ELSE '' END || ']' END AS calls FROM conversations""")
def tool_extract(spark, sf_dir):
    """Calls that stand in a fence in the answers of conversations, one as it is and one with arguments that are no object."""
    one = F.format_string('{"name": "f%d", "arguments": {"conv": %d, "deep": {"x": [1, "}"]}}}', F.col("turn") % 3, F.col("conv_id"))
    two = F.when(F.col("turn") % 2 == 1, '\n{"name": "g", "arguments": [1]}').otherwise("")
    turns = table(spark, sf_dir, "conversations").withColumn("plain", F.translate("text", "`{[", "   "))
    generated = F.when(F.col("role") == "assistant", F.concat("plain", F.lit("\n```json\n"), one, two, F.lit("\n```\ndone"))).otherwise(F.col("plain"))
    return turns.select("conv_id", "turn", tools.extracted(generated).alias("calls"))


def _made(spark, sf_dir):
    """A sample for each event."""
    return samples.made_of(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))


_TASK = "['no_tool', 'single_tool', 'multi_tool', 'tool_error', 'insufficient_result', 'requirement_change'][event_id % 6 + 1]"
_CITY, _TOPIC = "['Lisbon', 'Oslo', 'Quito', 'Hanoi', 'Perth'][event_id // 6 % 5 + 1]", "['tides', 'glaciers', 'sonnets', 'beetles'][event_id // 30 % 4 + 1]"
_SUM = "(event_id // 120 % 17 + 2 + event_id // 2040 % 13 + 3)"


@query(f"""WITH e AS (SELECT event_id, printf('made-%06d', event_id) AS sample_id, {_TASK} AS task, {_CITY} AS city, {_TOPIC} AS topic, {_SUM} AS total FROM events)
SELECT sample_id, sample_id || '-1' AS call_id, CASE WHEN task IN ('multi_tool', 'requirement_change') THEN 'weather' ELSE 'calculate' END AS tool_name, 'success' AS outcome,
  CASE WHEN task IN ('multi_tool', 'requirement_change') THEN '"' || city || ': clear, 21 degrees"' ELSE CAST(total AS VARCHAR) END AS result, NULL AS error FROM e WHERE task <> 'no_tool'
UNION ALL SELECT sample_id, sample_id || '-2', 'search', 'success', '"one result for ' || topic || '"', NULL FROM e WHERE task = 'multi_tool'""")
def topo_execute(spark, sf_dir):
    """Calls of samples made of events, run in dependency order."""
    call = lambda c: F.concat(F.lit('{"call_id":"'), c["call_id"], F.lit('","name":"'), c["name"], F.lit('","arguments":'), c["arguments"], F.lit(',"depends_on":'), F.to_json(c["depends_on"]), F.lit("}"))
    made = _made(spark, sf_dir).select("sample_id", F.concat(F.lit("["), F.array_join(F.transform("expected_tool_calls", call), ","), F.lit("]")).alias("calls"))
    ran = tools.execute(made, tools.example_tools()).select("sample_id", F.explode("results").alias("r"))
    return ran.select("sample_id", "r.*")


_L = ("parse_success", "schema_valid", "tool_name_correct", "argument_value_correct", "call_plan_matches", "execution_success", "result_grounded", "final_answer_correct")


_GRADES = f"""WITH e AS (SELECT printf('made-%06d', event_id) AS sample_id, {_TASK} AS task, event_id // 6 % 4 AS turn FROM events), n AS (SELECT *, task = 'no_tool' AS none, task = 'multi_tool' AS two FROM e),
g AS (SELECT sample_id, turn < 2 AS parse_success, CASE WHEN turn < 2 THEN turn = 1 OR none OR NOT (task IN ('multi_tool', 'requirement_change')) END AS schema_valid, CASE turn WHEN 0 THEN true WHEN 1 THEN none END AS tool_name_correct,
  CASE turn WHEN 0 THEN true WHEN 1 THEN none END AS argument_value_correct, CASE turn WHEN 0 THEN true WHEN 1 THEN none END AS call_plan_matches, CASE turn WHEN 0 THEN true WHEN 1 THEN CASE WHEN none THEN true END END AS execution_success,
  CASE turn WHEN 0 THEN true WHEN 1 THEN CASE WHEN none THEN true END END AS result_grounded, CASE WHEN turn = 0 OR none THEN true ELSE false END AS final_answer_correct FROM n),
f AS (SELECT *, {' + '.join(f'({x} IS NOT NULL)::INT' for x in _L)} AS applied, {' + '.join(f'coalesce({x}::INT, 0)' for x in _L)} AS ok FROM g)
SELECT * EXCLUDE (applied, ok), CASE {' '.join(f"WHEN NOT {x} THEN '{x}'" for x in _L)} END AS first_failure, CASE WHEN applied = ok AND applied > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward_binary, CASE WHEN applied > 0 THEN ok / applied ELSE 0.0 END AS reward_layered FROM f"""


@query(_GRADES)
def transcript_grades(spark, sf_dir):
    """Samples made of events, graded against transcripts that are right, have no calls, or are broken in two ways, by turns.
    The tools' schemas want an expression, or take anything; weather's wants numbers, so that its arguments break it."""
    made = _made(spark, sf_dir)
    wanted = F.transform("expected_tool_calls", lambda c: F.named_struct(F.lit("call_id"), c["call_id"], F.lit("name"), c["name"], F.lit("arguments"), F.from_json(c["arguments"], "map<string,string>"), F.lit("depends_on"), c["depends_on"], F.lit("expected_result"), c["expected_result"]))
    schema = lambda name, kind, field: f'{{"type": "function", "function": {{"name": "{name}", "parameters": {{"type": "object", "required": ["{field}"], "properties": {{"{field}": {{"type": "{kind}"}}}}}}}}}}'
    offered = f'[{schema("calculate", "string", "expression")}, {schema("weather", "number", "city")}, {schema("search", "string", "query")}]'
    body = F.to_json(F.struct(wanted.alias("expected_tool_calls"), "expected_answer"))
    sample = made.select("sample_id", F.concat(F.lit(f'{{"tools": {offered}, '), F.substring(body, F.lit(2), F.char_length(body))).alias("sample"))
    turn = F.floor(F.substring("sample_id", 6, 20).cast("long") / 6) % 4
    done = F.transform("expected_tool_calls", lambda c: F.named_struct(F.lit("call_id"), c["call_id"], F.lit("name"), c["name"], F.lit("arguments"), F.from_json(c["arguments"], "map<string,string>"), F.lit("depends_on"), c["depends_on"], F.lit("result"), c["expected_result"], F.lit("execution_outcome"), F.lit("success")))
    right = F.to_json(F.struct(done.alias("tool_calls"), F.col("expected_answer").alias("final_answer")))
    said = made.select("sample_id", F.when(turn == 0, right).when(turn == 1, F.lit('{"tool_calls": [], "final_answer": "no"}')).when(turn == 2, F.lit('{"final_answer": null}')).otherwise(F.lit('{"tool_calls": [null], "final_answer": "x"}')).alias("transcript"))
    return grade.graded(tools.grade_frames(sample, said))


@query(_GRADES)
def native_grades(spark, sf_dir):
    """The same samples and transcripts as columns, graded by built-in functions."""
    made = _made(spark, sf_dir)
    turn = F.floor(F.substring("sample_id", 6, 20).cast("long") / 6) % 4
    done = F.transform("expected_tool_calls", lambda c: F.named_struct(F.lit("call_id"), c["call_id"], F.lit("name"), c["name"], F.lit("arguments"), c["arguments"], F.lit("depends_on"), c["depends_on"], F.lit("result"), c["expected_result"], F.lit("outcome"), F.lit("success")))
    calls = F.when(turn == 0, done.cast(native_grade.ISSUED)).when(turn == 1, F.array().cast(native_grade.ISSUED))
    answer = F.when(turn == 0, F.col("expected_answer")).when(turn == 1, "no").when(turn == 3, "x")
    schema = lambda field, kind: {"type": "object", "required": [field], "properties": {field: {"type": kind}}}
    rows = made.withColumns({"tool_calls": calls, "final_answer": answer})
    out = native_grade.graded_layers(rows, {"calculate": schema("expression", "string"), "weather": schema("city", "number"), "search": schema("query", "string")})
    return grade.graded(out.select("sample_id", *grade.LAYERS))


@query()
def augmented_samples(spark, sf_dir):
    """Samples made of events, and two variants of each that has one call."""
    return samples.augmented(_made(spark, sf_dir), 2).select("sample_id", "task_type", "question", "expected_answer")


@query("""WITH n AS (SELECT sum(len(string_split(text, ' '))) AS tokens FROM documents WHERE text IS NOT NULL)
SELECT event_id, CAST(('0x' || left(sha256('7:' || (event_id // 64) || ':' || (event_id % 64)), 12))::BIGINT % (tokens - 128) AS BIGINT) AS start FROM events, n""")
def random_windows(spark, sf_dir):
    """A window start in the stream of all documents' words for each event, as a row of a batch of 64."""
    tokens = table(spark, sf_dir, "documents").agg(F.sum(F.size(F.split("text", " ", -1))).alias("tokens"), F.count("text").alias("texts"))
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("batch"), (F.col("event_id") % 64).alias("row")).crossJoin(F.broadcast(tokens))  # one row
    return windows.random_starts(rows, 7, F.col("tokens"), 128, "batch", "row").select("event_id", "start")
