"""Layers by built-in functions against the grader of documents, on random samples."""

import json
import random

from corpusloom.operators import grade, native_grade
from corpusloom.operators.tools import grade_transcript

SCHEMAS = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}, "g": {"type": "object"}}


def test_same_as_the_grader_of_documents(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(500):
        call = lambda i, last: ("c" + str(rng.choice([i, i, i, 9])), rng.choice("ffgh"), rng.choice(['{"a": 1}', '{"a": 1}', '{"a": "x"}', "{}", "[1]"]), rng.choice([[], [], ["c0"], ["c0", "c1"]]), last)
        wanted = [call(i, rng.choice([None, "r", "s"])) for i in range(rng.randrange(3))]
        issued = None if rng.random() < 0.1 else [(*w[:4], w[4] or "r", "success") for w in wanted] if rng.random() < 0.4 else [(*call(i, rng.choice(["r", "s"])), rng.choice(["success", "success", "failed"])) for i in range(rng.randrange(3))]
        target, answer = rng.choice([None, "", "yes"]), rng.choice([None, "", "oh yes", "no"])
        rows.append((k, wanted, issued, target, answer))
        sample = {"tools": [{"function": {"name": n, "parameters": s}} for n, s in SCHEMAS.items()], "expected_answer": target}
        sample["expected_tool_calls"] = [{"call_id": c, "name": n, "arguments": json.loads(a), "depends_on": d, **({"expected_result": r} if r else {})} for c, n, a, d, r in wanted]
        transcript = {"final_answer": answer, "tool_calls": None if issued is None else [{"call_id": c, "name": n, "arguments": json.loads(a), "depends_on": d, "result": r, "execution_outcome": o} for c, n, a, d, r, o in issued]}
        want[k] = grade_transcript(sample, transcript)
    df = spark.createDataFrame(rows, f"k int, expected_tool_calls {native_grade.WANTED}, tool_calls {native_grade.ISSUED}, expected_answer string, final_answer string")
    for r in native_grade.graded_layers(df, SCHEMAS).collect():
        assert {x: r[x] for x in grade.LAYERS} == want[r.k], (rows[r.k], want[r.k])
    assert all(len({w[x] for w in want.values()}) > 1 for x in grade.LAYERS)
