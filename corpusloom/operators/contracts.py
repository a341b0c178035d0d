"""Contracts of data sets and runs: each gives a row for each violation, or projections that comparisons need."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import canonical_json

#: Fields that name or date a sample and say nothing of its contents.
IDENTITY = ("id", "call_id", "tool_call_id", "depends_on")
DATED = ("created_at", "split", "created_at_pos")


def without_identity(value, inside_metadata: bool = False):
    """A JSON value without ids, dependencies and, in metadata, times, splits and positions."""
    if isinstance(value, dict):
        gone = IDENTITY + (DATED if inside_metadata else ())
        return {k: without_identity(v, k == "metadata") for k, v in value.items() if k not in gone}
    return [without_identity(v) for v in value] if isinstance(value, list) else value


def content_signature(raw: Column) -> Column:
    """The digest of a sample's canonical form without identity: equal for copies in any split. No JSON: null."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(x):
            try:
                return canonical_json(without_identity(json.loads(x)))
            except (TypeError, ValueError):
                return None

        return rows.map(one)

    return F.sha2(run(raw), 256)


def comparable_signature(raw: Column) -> Column:
    """The digest of what two differently built sets have in common: plain turns, answer, task, tool names and calls as
    sorted lists."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(x):
            try:
                s = json.loads(x)
            except (TypeError, ValueError):
                return None
            turns = [(m.get("role"), m.get("content")) for m in s.get("messages") or [] if m.get("role") == "user" or m.get("role") == "assistant" and not m.get("tool_calls")]
            names = sorted(str((t.get("function") or t).get("name")) for t in s.get("tools") or [])
            calls = sorted([str(c.get("name")), canonical_json(c.get("arguments"))] for c in s.get("expected_tool_calls") or [])
            return canonical_json([turns, names, calls, s.get("expected_answer"), (s.get("metadata") or {}).get("task_type")])

        return rows.map(one)

    return F.sha2(run(raw), 256)


def _violations(df: DataFrame, key: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    names = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(names).alias("violation"))


def run_violations(rollouts: DataFrame, key: str = "step_id", reward: str = "reward", advantage: str = "advantage", tolerance: float = 1e-5) -> DataFrame:
    """Steps whose rewards leave [0, 1], whose advantages have a mean that is not 0, or whose rewards do not vary at all."""
    stats = rollouts.groupBy(key).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"), F.avg(advantage).alias("m"), F.stddev_pop(reward).alias("s"), F.max(F.abs(advantage)).alias("a"))
    checks = [("reward_bounds", (F.col("lo") < 0) | (F.col("hi") > 1)), ("advantage_mean", F.abs("m") > tolerance), ("no_variance", (F.col("s") == 0) & (F.col("a") != 0))]
    return _violations(stats, [key], checks)


def run_mismatches(a: DataFrame, b: DataFrame, key: str = "step_id", value: str = "sha256") -> DataFrame:
    """Steps that two runs do not have in common, or with another digest."""
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer").where("not (a <=> b)")


def fingerprint(items: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The digest of a group's texts in order, each with a NUL behind it. A group is one prompt's rollouts."""
    parts = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("x"))
    return parts.select(key, F.sha2(F.array_join(F.transform("x", lambda x: F.concat(x["t"], F.char(F.lit(0)))), ""), 256).alias("sha256"))


def settings_differ(saved: dict, now: dict, tolerance: float = 1e-9) -> list[str]:
    """Names of settings that differ; numbers within the tolerance agree."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    same = lambda a, b: abs(a - b) <= tolerance if number(a) and number(b) else a == b
    return sorted(k for k in saved.keys() | now.keys() if k not in saved or k not in now or not same(saved[k], now[k]))


def provenance_violations(artifacts: DataFrame, expected: DataFrame, commits: list[str], key: str = "artifact") -> DataFrame:
    """Artifacts that are missing, made from another commit, or with another seed, number of steps or status."""
    e = expected.select(key, *[F.col(c).alias(f"e_{c}") for c in ("seed", "steps", "status")])
    both = e.join(artifacts.withColumn("_here", F.lit(True)), key, "left")
    checks = [("missing", F.col("_here").isNull()), ("commit", F.col("_here") & ~F.col("commit").isin(*commits))]
    checks += [(c, F.col("_here") & ~F.col(c).eqNullSafe(F.col(f"e_{c}"))) for c in ("seed", "steps", "status")]
    return _violations(both, [key], [(n, F.coalesce(x, F.lit(False))) for n, x in checks])


def set_violations(samples: DataFrame, kinds: list[str], source: str = "synthetic") -> DataFrame:
    """Samples from another source, and wanted kinds without a sample."""
    odd = samples.where(~F.col("source").eqNullSafe(F.lit(source))).select(F.col("id").alias("what"), F.lit("source").alias("violation"))
    need = samples.sparkSession.createDataFrame([(k,) for k in kinds], "what string")
    return odd.union(need.join(samples.select(F.col("task_type").alias("what")).distinct(), "what", "left_anti").select("what", F.lit("coverage")))


def guarded(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected candidates: a sample that needs no tool has no calls, and any other has some."""
    fits = (F.col("task_type") == "no_tool") == (F.size("expected_tool_calls") == 0)
    return samples.where(fits), samples.where(~F.coalesce(fits, F.lit(False)))


def finite(values: Column) -> Column:
    return ~F.isnan(values) & (F.abs(values) != float("inf"))


def result_differences(expected: DataFrame, ran: DataFrame, sample: str = "sample_id", pos: str = "pos") -> DataFrame:
    """sample, pos, fault of every call that did not succeed when run again (outcome) or gave another result than the one
    expected (result). Calls meet by their place; one without a partner, or without an expected result, has none."""
    both = expected.select(sample, pos, "expected_result").join(ran.select(sample, pos, "outcome", "result"), [sample, pos])
    other = F.col("expected_result").isNotNull() & ~F.col("expected_result").eqNullSafe(F.col("result"))
    fault = F.when(~F.col("outcome").eqNullSafe(F.lit("success")), "outcome").when(other, "result")
    return both.select(sample, pos, fault.alias("fault")).where("fault is not null")
