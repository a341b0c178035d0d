"""Tool-calling samples: a seeded generator, training examples, augmentation, metadata."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import radix, timestamp_text
from .tools import calculate

CITIES = ["Lisbon", "Oslo", "Quito", "Hanoi", "Perth"]
TOPICS = ["tides", "glaciers", "sonnets", "beetles"]
KINDS = ["no_tool", "single_tool", "multi_tool", "tool_error", "insufficient_result", "requirement_change"]
CALL = "array<struct<call_id: string, name: string, arguments: string, depends_on: array<string>, expected_result: string>>"


def generate(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n samples, numbered from 0."""
    return made_of(spark.range(n), seed)


def made_of(ids: DataFrame, seed: int = 0) -> DataFrame:
    """A sample for each row's id: sample_id, task_type, question, expected_tool_calls, expected_answer, created_at. Values come
    from the id in a mixed radix, so any part can be made alone."""
    v = F.col("id") + seed
    kind, city, topic, x, y = radix(v, [len(KINDS), len(CITIES), len(TOPICS), 17, 13])
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    rows = ids.select("id", pick(KINDS, kind).alias("task_type"), pick(CITIES, city).alias("city"), pick(TOPICS, topic).alias("topic"), (x + 2).alias("x"), (y + 3).alias("y"))
    rows = rows.withColumn("sample_id", F.format_string("made-%06d", "id")).withColumn("expr", F.concat_ws(" + ", "x", "y"))
    call = lambda i, name, args, deps, result: F.struct(F.concat("sample_id", F.lit(f"-{i}")).alias("call_id"), F.lit(name).alias("name"), args.alias("arguments"), deps.alias("depends_on"), result.alias("expected_result"))
    none = F.array().cast("array<string>")
    calc = call(1, "calculate", F.to_json(F.struct(F.col("expr").alias("expression"))), none, (F.col("x") + F.col("y")).cast("string"))
    weather = call(1, "weather", F.to_json(F.struct("city")), none, F.concat("city", F.lit(": clear, 21 degrees")))
    search = call(2, "search", F.to_json(F.struct(F.col("topic").alias("query"))), F.array(F.concat("sample_id", F.lit("-1"))), F.concat(F.lit("one result for "), "topic"))
    calls = F.when(F.col("task_type") == "no_tool", F.array().cast(CALL)).when(F.col("task_type") == "multi_tool", F.array(weather, search).cast(CALL)).when(F.col("task_type") == "requirement_change", F.array(weather).cast(CALL)).otherwise(F.array(calc).cast(CALL))
    question = F.when(F.col("task_type") == "no_tool", F.concat(F.lit("Say a word on "), "topic")).when(F.col("task_type").isin("multi_tool", "requirement_change"), F.concat(F.lit("What is the weather in "), "city")).otherwise(F.concat(F.lit("What is "), "expr"))
    return rows.select("sample_id", "task_type", question.alias("question"), calls.alias("expected_tool_calls"), F.coalesce(F.try_element_at(calls, F.lit(-1))["expected_result"], F.lit("")).alias("expected_answer"), timestamp_text(seed, F.col("id")).alias("created_at"))


def plan_text(calls: Column) -> Column:
    """One compact JSON object for each call; depends_on only where there is any."""
    one = lambda c: F.concat(
        F.lit('{"name":'), F.to_json(F.array(c["name"])).substr(F.lit(2), F.length(F.to_json(F.array(c["name"]))) - 2), F.lit(',"call_id":'), F.to_json(F.array(c["call_id"])).substr(F.lit(2), F.length(F.to_json(F.array(c["call_id"]))) - 2),
        F.lit(',"arguments":'), c["arguments"], F.when(F.size(c["depends_on"]) > 0, F.concat(F.lit(',"depends_on":'), F.to_json(c["depends_on"]))).otherwise(""), F.lit("}"),
    )
    return F.array_join(F.transform(calls, one), "\n")


def result_summary(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: F.concat(c["name"], F.lit(" = "), c["expected_result"])), "; ")


def training_example(prefix: Column, body: Column, end: int, length: int) -> list[Column]:
    """inputs, targets and mask of a prompt and its answer: the answer and the end are learned; cut on the right."""
    ids = F.slice(F.concat(prefix, body, F.array(F.lit(end))), 1, length + 1)
    mask = F.slice(F.concat(F.array_repeat(F.lit(0), F.size(prefix)), F.array_repeat(F.lit(1), F.size(body) + 1)), 1, length + 1)
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return [F.slice(ids, F.lit(1), n).alias("inputs"), F.slice(ids, F.lit(2), n).alias("targets"), F.slice(mask, F.lit(2), n).alias("mask")]


def learnable(examples: DataFrame) -> DataFrame:
    return examples.where(F.exists("mask", lambda m: m > 0))


def padded(examples: DataFrame, batch: str, column: str, fill: int) -> DataFrame:
    """Each array filled up to the longest of its batch; maxima are made before the shuffle."""
    longest = examples.groupBy(batch).agg(F.max(F.size(column)).alias("_m"))
    return examples.join(longest, batch).withColumn(column, F.concat(column, F.array_repeat(F.lit(fill), F.col("_m") - F.size(column)))).drop("_m")


def perturbed(expression: str, delta: int) -> str:
    """The first two integers of an expression plus delta, 1 at least."""
    return re.sub(r"\d+", lambda m: str(max(1, int(m[0]) + delta)), expression, count=2)


def augmented(samples: DataFrame, copies: int) -> DataFrame:
    """samples and up to ``copies`` variants of each single call, numbered; question, call and answer change together.
    A variant that equals its source is not made."""

    @F.pandas_udf("array<struct<i: int, question: string, arguments: string, result: string>>")
    def variants(question: pd.Series, name: pd.Series, arguments: pd.Series) -> pd.Series:
        def one(q, n, a):
            out = []
            if n == "calculate":
                old = json.loads(a)["expression"]
                for i in range(1, copies + 1):
                    new = perturbed(old, i)
                    if new != old and old in q:
                        out.append({"i": i, "question": q.replace(old, new), "arguments": json.dumps({"expression": new}, separators=(",", ":")), "result": str(calculate(new))})
            elif n == "weather":
                old = json.loads(a)["city"]
                for i, city in enumerate([c for c in CITIES if c != old][:copies], 1):
                    out.append({"i": i, "question": q.replace(old, city), "arguments": json.dumps({"city": city}, separators=(",", ":")), "result": f"{city}: clear, 21 degrees"})
            return out

        return pd.Series([one(*x) for x in zip(question, name, arguments, strict=True)], dtype=object)

    first = F.get("expected_tool_calls", F.lit(0))
    made = samples.where(F.size("expected_tool_calls") == 1).withColumn("v", F.explode(variants(F.col("question"), first["name"], first["arguments"])))
    sample_id = F.format_string("%s-aug%d", "sample_id", F.col("v.i"))
    call = F.struct(F.concat(sample_id, F.lit("-1")).alias("call_id"), first["name"].alias("name"), F.col("v.arguments").alias("arguments"), F.array().cast("array<string>").alias("depends_on"), F.col("v.result").alias("expected_result"))
    made = made.select(sample_id.alias("sample_id"), "task_type", F.col("v.question").alias("question"), F.array(call).cast(CALL).alias("expected_tool_calls"), F.col("v.result").alias("expected_answer"), "created_at")
    return samples.unionByName(made)


UNSET = "unset"
METADATA = ("commit", "config_sha256", "dataset_sha256", "tokenizer_sha256", "seed", "python", "spark", "device", "started_at", "status")


def metadata(**known) -> dict[str, str]:
    """The ten provenance fields, with ``unset`` for what is not known."""
    if odd := known.keys() - set(METADATA):
        raise ValueError(f"no such fields: {sorted(odd)}")
    return {k: str(known[k]) if known.get(k) is not None else UNSET for k in METADATA}
