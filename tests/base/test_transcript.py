"""The transcript machine against a walk in plain Python."""

import json
import random

from corpusloom.operators import transcript as T

SCHEMA = "conv_id long, messages array<struct<role: string, content: string, calls: array<struct<id: string, name: string, arguments: string>>, answers: string>>, expected array<struct<call_id: string, name: string, arguments: string>>, expected_answer string"


def walk(messages, expected, answer):
    out, waiting, asked, answered = [], [], [], []
    final = max((i for i, m in enumerate(messages) if m[0] == "assistant" and not m[2] and m[1]), default=None)
    for i, (role, _, calls, ref) in enumerate(messages):
        late = final is not None and i > final
        if role == "assistant" and calls:
            if late:
                out.append((i, "call_after_answer", None))
            waiting += [c[0] for c in calls]
            asked += [c[0] for c in calls]
        elif role == "tool" and not ref:
            out.append((i, "tool_without_id", None))
        elif role == "tool":
            answered.append(ref)
            if late:
                out.append((i, "tool_after_answer", ref))
            elif not waiting:
                out.append((i, "tool_before_call", ref))
            elif waiting[0] != ref:
                out.append((i, "out_of_order", ref))
            else:
                waiting.pop(0)
        elif role not in ("assistant", "system", "user"):
            out.append((i, "role", role))
    out += [(None, "unanswered", x) for x in waiting]
    out += [(None, "never_answered", x) for x in {*asked} - {*answered}] + [(None, "unknown_id", x) for x in {*answered} - {*asked}]
    known = {e[0]: e for e in expected}
    for i, (role, _, calls, _) in enumerate(messages):
        for c in calls if role == "assistant" else ():
            if c[0] not in known:
                out.append((i, "undeclared", c[0]))
                continue
            if known[c[0]][1] != c[1]:
                out.append((i, "name", c[0]))
            if json.loads(known[c[0]][2]) != json.loads(c[2]):
                out.append((i, "arguments", c[0]))
    if answer is None:
        out.append((None, "answer_missing", None))
    elif final is None:
        out.append((None, "no_answer", None))
    elif messages[final][1] != answer:
        out.append((final, "answer_differs", None))
    return out


def test_random_transcripts(spark):
    rng, rows = random.Random(2), []
    for k in range(400):
        messages = []
        for _ in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "tool", "system", "critic"])
            calls = [(f"c{rng.randrange(4)}", rng.choice("fg"), rng.choice(['{"a": 1, "b": [2]}', '{"b":[2],"a":1}', "{}"])) for _ in range(rng.randrange(1, 3))] if role == "assistant" and rng.random() < 0.6 else []
            messages.append((role, rng.choice(["", "yes", "no", None]), calls, rng.choice([None, "", "c0", "c1", "c2", "c3"]) if role == "tool" else None))
        expected = [(f"c{i}", rng.choice("fg"), '{"a": 1, "b": [2]}') for i in rng.sample(range(4), rng.randrange(5))]
        rows.append((k, messages, expected, rng.choice([None, "yes", "no"])))
    got = T.transcript_faults(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(k, *f) for k, m, e, a in rows for f in walk(m, e, a)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({f[2] for f in want}) == 15
    assert T.transcript_faults(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_right_one(spark):
    messages = [("user", "q", [], None)]
    for i in range(60):
        messages += [("assistant", "", [(f"a{i}", "f", "{}"), (f"b{i}", "f", "{}")], None), ("tool", "1", [], f"a{i}"), ("tool", "2", [], f"b{i}")]
    messages.append(("assistant", "done", [], None))
    expected = [(f"{x}{i}", "f", "{ }") for i in range(60) for x in "ab"]
    assert T.transcript_faults(spark.createDataFrame([(1, messages, expected, "done")], SCHEMA)).collect() == []
