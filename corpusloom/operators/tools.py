"""Tools: a registry, execution of call sequences in dependency order, call extraction, grading of transcripts."""

from __future__ import annotations

import ast
import json
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import check

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}


def calculate(expression: str) -> int:
    """The rounded value of an arithmetic expression; ^ is a power. Names, calls and huge powers are errors."""

    def value(node):
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow):
                if abs(b) > 64 or abs(a) > 1e6:
                    raise ValueError("the power is too large")
                return a**b
            if type(node.op) in _OPS:
                return _OPS[type(node.op)](a, b)
        raise ValueError("not arithmetic")

    return int(round(value(ast.parse(expression.replace("^", "**"), mode="eval"))))


@dataclass
class ToolRegistry:
    """Functions by name, each with a schema of its arguments. Nothing is imported by names that come from data."""

    tools: dict[str, tuple[Callable, dict]] = field(default_factory=dict)

    def register(self, name: str, fn: Callable, schema: dict) -> ToolRegistry:
        self.tools[name] = (fn, schema)
        return self

    def call(self, name: str, arguments: dict) -> dict:
        """outcome, result, error. An unknown tool comes before bad arguments, and these before an exception."""
        if name not in self.tools:
            return {"outcome": "mock_not_found", "result": None, "error": f"no tool {name}"}
        fn, schema = self.tools[name]
        if errors := check(schema, arguments):
            return {"outcome": "argument_invalid", "result": None, "error": "; ".join(errors)}
        try:
            return {"outcome": "success", "result": fn(**arguments), "error": None}
        except Exception as e:  # a tool may raise anything
            return {"outcome": "mock_exception", "result": None, "error": f"{type(e).__name__}: {e}"}

    def run(self, calls: list[dict]) -> list[dict]:
        """A result for each call, in the order of execution: level by level of dependencies, input order within a level.
        A call whose dependency failed, is missing or is in a cycle is skipped."""
        left = {i: set(c.get("depends_on") or ()) for i, c in enumerate(calls)}
        ids = {c.get("call_id") for c in calls}
        done: dict[str, str] = {}
        out = []
        skipped = lambda c, why: {"call_id": c.get("call_id"), "tool_name": c.get("name"), "outcome": "skipped", "result": None, "error": why}
        while left:
            ready = [i for i, deps in left.items() if all(d in done or d not in ids for d in deps)]
            if not ready:
                out += [skipped(calls[i], "in a cycle of dependencies") for i in left]
                break
            for i in ready:
                c, bad = calls[i], sorted(d for d in left[i] if done.get(d) != "success")
                r = skipped(c, f"dependency {bad[0]} did not complete") if bad else {"call_id": c.get("call_id"), "tool_name": c.get("name"), **self.call(c.get("name"), c.get("arguments") or {})}
                out.append(r)
            for r, i in zip(out[-len(ready) :], ready, strict=True):
                done[r["call_id"]] = r["outcome"]
                del left[i]
        return out


RESULT = "array<struct<call_id: string, tool_name: string, outcome: string, result: string, error: string>>"


def execute(df: DataFrame, registry: ToolRegistry, calls: str = "calls") -> DataFrame:
    """df with results: the outcomes of each row's calls (a JSON array). Rows are independent; no shuffle."""
    tools = df.sparkSession.sparkContext.broadcast(registry)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [r | {"result": None if r["result"] is None else json.dumps(r["result"])} for r in tools.value.run(json.loads(t) if t else [])])

    return df.withColumn("results", run(calls))


def registered(spark, registry: ToolRegistry) -> None:
    """Makes the tools SQL functions of JSON arguments, named tool_<name>, which give the outcome as JSON."""
    for name in registry.tools:
        spark.udf.register(f"tool_{name}", F.pandas_udf("string")(_as_udf(registry, name)))


def _as_udf(registry: ToolRegistry, name: str):
    def f(arguments: pd.Series) -> pd.Series:
        return arguments.map(lambda a: json.dumps(registry.call(name, json.loads(a))))

    return f


def example_tools() -> ToolRegistry:
    number = {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {"a": {"type": "number"}, "b": {"type": "number"}}}
    text = lambda k: {"type": "object", "required": [k], "additionalProperties": False, "properties": {k: {"type": "string", "minLength": 1}}}
    return (
        ToolRegistry()
        .register("add", _add, number)
        .register("multiply", _multiply, number)
        .register("divide", _divide, number)
        .register("calculate", calculate, text("expression"))
        .register("weather", _weather, text("city"))
        .register("search", _search, text("query"))
        .register("translate", _translate, {"type": "object", "required": ["text", "target"], "properties": {"text": {"type": "string", "minLength": 1}, "target": {"type": "string", "minLength": 1}}})
    )


def _add(a, b):
    return a + b


def _multiply(a, b):
    return a * b


def _divide(a, b):
    return a / b


def _weather(city):
    return f"{city}: clear, 21 degrees"


def _search(query):
    return f"one result for {query}"


def _translate(text, target):
    """A service that is never there: the call succeeds, and its result is an error to report."""
    return f"ERROR: translation is unavailable (text={text!r}, target={target!r})"


def extract_calls(text: str | None, legacy_array_first: bool = False) -> list[dict] | None:
    """The calls in a generated text: JSON objects with a name, alone or in an array; None if there are none.

    Braces are matched with regard to strings. With ``legacy_array_first`` the text between the first [ and the first ] is
    tried before objects, which loses plans whose objects hold arrays.
    """
    if not text:
        return None
    body = text
    if "```" in body:
        parts = body.split("```")
        body = "\n".join(p.removeprefix("json").removeprefix("JSON") for p in parts[1::2]) or body
    if legacy_array_first and "[" in body and "]" in body[body.index("[") :]:
        try:
            found = json.loads(body[body.index("[") : body.index("]", body.index("[")) + 1])
            return [c for c in found if isinstance(c, dict) and "name" in c]
        except ValueError:
            pass
    decoder, found, i = json.JSONDecoder(), [], 0
    while i < len(body):
        if body[i] in "[{":
            try:
                value, i = decoder.raw_decode(body, i)
            except ValueError:
                i += 1
                continue
            found += [c for c in (value if isinstance(value, list) else [value]) if isinstance(c, dict) and "name" in c]
        else:
            i += 1
    return [c | {"arguments": _arguments(c.get("arguments"))} for c in found] or None


def _arguments(raw) -> dict:
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError:
            return {}
    return raw if isinstance(raw, dict) else {}


def extracted(text: Column, legacy_array_first: bool = False, none_is_empty: bool = False) -> Column:
    """Extracted calls as JSON. No calls: null, which is a parse failure, or with none_is_empty an empty array."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            calls = extract_calls(t, legacy_array_first)
            return json.dumps([] if calls is None and none_is_empty else calls, ensure_ascii=False) if calls is not None or none_is_empty else None

        return texts.map(one)

    return run(text)


_MISSING = object()


def grade_transcript(sample: dict, transcript: dict) -> dict[str, bool | None]:
    """The eight layers of one transcript: true, false, or None where a layer does not apply."""
    wanted, calls = sample.get("expected_tool_calls") or [], transcript.get("tool_calls", _MISSING)
    answer, target = transcript.get("final_answer"), sample.get("expected_answer")
    last = None if target is None else str(target) in (answer if isinstance(answer, str) else "")
    out: dict[str, bool | None] = dict.fromkeys(("parse_success", "schema_valid", "tool_name_correct", "argument_value_correct", "call_plan_matches", "execution_success", "result_grounded"))
    out["final_answer_correct"] = last
    out["parse_success"] = isinstance(calls, list) and all(isinstance(c, dict) for c in calls)
    if not out["parse_success"]:
        return out
    tools = {}
    for t in sample.get("tools") or []:
        f = t.get("function", t)
        tools.setdefault(f.get("name"), f.get("parameters") or {})
    valid: bool | None = True
    for c in calls:
        name = c.get("name")
        if not isinstance(name, str) or name not in tools:
            valid = None
        elif check(tools[name], c.get("arguments", {})):  # as they are: a text or a list is no object
            valid = False if valid else None
            break
    out["schema_valid"] = valid
    # the kind in front keeps what is no name apart from a name that reads the same
    name = lambda c: (type(c.get("name")).__name__, str(c.get("name")))
    text = lambda c: (name(c), json.dumps(c.get("arguments"), sort_keys=True))
    out["tool_name_correct"] = sorted(map(name, calls)) == sorted(map(name, wanted))
    out["argument_value_correct"] = sorted(map(text, calls)) == sorted(map(text, wanted))
    out["call_plan_matches"] = _plan_fits(wanted, calls)
    out["execution_success"] = (None if wanted else True) if not calls else all(c.get("execution_outcome") == "success" for c in calls)
    declared = [(w["expected_result"], c.get("result")) for w, c in zip(wanted, calls, strict=False) if "expected_result" in w]
    out["result_grounded"] = all(a == b for a, b in declared) if declared else (None if wanted else True)
    return out


def _plan_fits(wanted: list[dict], calls: list[dict]) -> bool:
    if len(wanted) != len(calls):
        return False
    ids: list = []
    for w, c in zip(wanted, calls, strict=True):
        deps = c.get("depends_on") or []
        same = all(w.get(k) == c.get(k) for k in ("name", "call_id", "arguments"))
        if not same or not isinstance(deps, list) or sorted(map(str, deps)) != sorted(map(str, w.get("depends_on") or [])):
            return False
        if any(d not in ids for d in deps):
            return False
        ids.append(c.get("call_id"))
    return True


def _object(text: str | None) -> dict:
    """A JSON object; an empty one for null, broken JSON or another kind of value."""
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


_FIRST = re.compile(r'\s*\{\s*"((?:[^"\\\x00-\x1f])*)"\s*:\s*')


class _Objects:
    """``_object`` for texts of which many begin with the same member, an array or an object, as samples do with their tools:
    that member is parsed again only where its text changes. Values may be shared by several results."""

    def __init__(self):
        self.begin, self.name, self.value = None, "", None

    def of(self, text: str | None) -> dict:
        if text and self.begin and text.startswith(self.begin):
            rest = text[len(self.begin) :].lstrip(" \t\n\r")
            if rest[:1] == ",":
                # a comma with nothing behind it is no JSON, so an empty rest is left to the parser of the whole
                if more := _object("{" + rest[1:]):
                    return {self.name: self.value} | more
        elif text and (m := _FIRST.match(text)) and text[m.end() : m.end() + 1] in ("[", "{"):
            try:
                value, end = json.JSONDecoder().raw_decode(text, m.end())
                self.begin, self.name, self.value = text[:end], m[1], value
            except ValueError:
                pass
        return _object(text)


def rollout_rewards(samples: DataFrame, rollouts: DataFrame, key: str = "sample_id", index: str = "rollout_index") -> DataFrame:
    """key, rollout index, the eight layers, first failure and both rewards of every rollout of a sample.

    rollouts: key, index, transcript (JSON). A rollout of no sample has no row.
    """
    from .grade import graded

    tagged = rollouts.select(F.struct(key, index).alias("_id"), key, "transcript")
    wanted = samples.join(tagged.select("_id", key), key).select("_id", "sample")
    return graded(grade_frames(wanted, tagged.select("_id", "transcript"), "_id")).select("_id.*", "*").drop("_id")


def grade_frames(samples: DataFrame, transcripts: DataFrame, key: str = "sample_id") -> DataFrame:
    """key and eight nullable layers. samples: key, sample (JSON); transcripts: key, transcript (JSON)."""
    from .grade import LAYERS

    @F.pandas_udf("struct<" + ", ".join(f"{x}: boolean" for x in LAYERS) + ">")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        wanted = _Objects()
        rows = [grade_transcript(wanted.of(x), _object(y)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=list(LAYERS)).astype("object")

    both = samples.join(transcripts, key)
    return both.select(key, run("sample", "transcript").alias("g")).select(key, "g.*")
