"""Contracts of training runs: counters over resumes, bounds and variation of rewards, equal runs, and chains of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def islands(steps: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """run, island (from 0), first, last, n: stretches of steps without a gap; repeated steps are in the stretch they repeat."""
    w = W.partitionBy(run).orderBy(step)
    starts = steps.select(run, step, (F.col(step) > F.coalesce(F.lag(step).over(w), F.col(step) - 2) + 1).cast("int").alias("_s"))
    numbered = starts.select(run, step, (F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("island"))
    return numbered.groupBy(run, "island").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("n"))


def counter_violations(steps: DataFrame, expected: DataFrame, run: str = "run") -> DataFrame:
    """run, step, contract of counters that do not go on as a resumed run's must.

    steps: run, step (from 0), samples_consumed, max_steps, completed. expected: run, n_steps. gap: steps before this one are
    missing; repeat: the step is there already; consumed: not one more than at the step before; early: completed before the
    last step; and of a run's last row last_step, last_consumed, last_max, not_completed. A run without steps: no_steps.
    """
    w = W.partitionBy(run).orderBy("step", "samples_consumed")
    rows = steps.select(run, "step", "samples_consumed", "max_steps", "completed").withColumns({"_p": F.lag("step").over(w), "_c": F.lag("samples_consumed").over(w), "_last": F.lead("step").over(w).isNull()})
    rows = rows.join(expected.select(run, "n_steps"), run)
    gap = F.when(F.col("_p").isNull(), F.col("step") != 0).otherwise(F.col("step") > F.col("_p") + 1)
    last = lambda bad: F.col("_last") & F.coalesce(bad, F.lit(True))
    checks = [
        ("gap", gap),
        ("repeat", F.col("step") == F.col("_p")),
        ("consumed", (F.col("step") == F.col("_p") + 1) & (F.col("samples_consumed") != F.col("_c") + 1)),
        ("early", ~F.col("_last") & F.col("completed")),
        ("last_step", last(F.col("step") != F.col("n_steps") - 1)),
        ("last_consumed", last(F.col("samples_consumed") != F.col("n_steps"))),
        ("last_max", last(F.col("max_steps") != F.col("n_steps"))),
        ("not_completed", last(~F.col("completed"))),
    ]
    found = rows.select(run, "step", F.explode(_broken(checks)).alias("contract"))
    none = expected.join(steps.select(run).distinct(), run, "left_anti").select(run, F.lit(None).cast("long").alias("step"), F.lit("no_steps").alias("contract"))
    return found.unionByName(none)


def _broken(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]))


def step_figures(artifacts: DataFrame, run: str = "run") -> DataFrame:
    """run, step, n_rollouts, reward_min, reward_max, n_rewards (different ones), advantage_mean, advantage_std, n_calls,
    n_chars of each step. artifacts: run, step, rollouts (array of reward, advantage, n_calls, generated). The shuffle comes
    before the rollouts are rows, so that no task holds the steps of a whole file."""
    r = artifacts.select(run, "step", "rollouts").repartition(run, "step").select(run, "step", F.explode("rollouts").alias("r"))
    return r.groupBy(run, "step").agg(
        F.count("*").alias("n_rollouts"),
        F.min("r.reward").alias("reward_min"),
        F.max("r.reward").alias("reward_max"),
        F.count_distinct("r.reward").alias("n_rewards"),
        F.avg("r.advantage").alias("advantage_mean"),
        F.stddev_pop("r.advantage").alias("advantage_std"),
        F.sum("r.n_calls").alias("n_calls"),
        F.sum(F.char_length("r.generated")).alias("n_chars"),
    )


def reward_violations(artifacts: DataFrame, natural: list[str], run: str = "run", tolerance: float = 1e-5) -> DataFrame:
    """run, step, contract: reward_bounds (outside 0 to 1), advantage_mean (not 0 although rewards vary), and of the
    runs in ``natural``, whose updates have to come from rewards that vary by themselves: skipped, tokens, loss, injected, no_spread.
    artifacts also have skipped, tokens_seen, loss and injected."""
    both = artifacts.select(run, "step", "skipped", "tokens_seen", "loss", "injected").join(step_figures(artifacts, run), [run, "step"], "left")
    mine = F.col(run).isin(natural) if natural else F.lit(False)
    checks = [
        ("reward_bounds", (F.col("reward_min") < 0) | (F.col("reward_max") > 1)),
        ("advantage_mean", (F.col("reward_min") < F.col("reward_max")) & (F.abs("advantage_mean") > tolerance)),
        ("skipped", mine & F.col("skipped")),
        ("tokens", mine & ~(F.col("tokens_seen") > 0)),
        ("loss", mine & (F.coalesce("loss", F.lit(0.0)) == 0)),
        ("injected", mine & F.col("injected")),
        ("no_spread", mine & ~(F.coalesce("advantage_std", F.lit(0.0)) > 0)),
    ]
    return both.select(run, "step", F.explode(_broken(checks)).alias("contract"))


def pair_violations(artifacts: DataFrame, a: str, b: str, hashes: list[str], run: str = "run") -> DataFrame:
    """run (of the first), step, contract: steps that only one of two runs has (unpaired), or with another digest (its name).
    artifacts: run, step and columns of digests."""
    side = lambda r, x: artifacts.where(F.col(run) == r).select("step", *[F.col(h).alias(f"{x}_{h}") for h in hashes], F.lit(True).alias(f"_{x}"))
    both = side(a, "a").join(side(b, "b"), "step", "full_outer")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    checks = [("unpaired", alone), *[(h, ~alone & ~F.col(f"a_{h}").eqNullSafe(F.col(f"b_{h}"))) for h in hashes]]
    return both.select(F.lit(a).alias(run), "step", F.explode(_broken(checks)).alias("contract"))


def binding_chain(artifacts: DataFrame, bindings: DataFrame, roots: DataFrame, levels: int = 8) -> DataFrame:
    """root, depth, artifact, bound_to, fault of the first broken binding on each root's chains: the one nearest to the root, of
    equals the least names. artifacts: artifact, sha256. bindings: artifact, bound_to, sha256 (what the artifact says that the
    other one's digest is). roots: artifact. fault: missing, hash, or deep (a chain has ``levels`` steps or more, as a
    cycle has). Each step is a join of all chains at once; a broken chain goes no further.
    """
    known = artifacts.select(F.col("artifact").alias("bound_to"), F.col("sha256").alias("_is"))
    claims = bindings.select("artifact", "bound_to", F.col("sha256").alias("_says"))
    at = roots.select(F.col("artifact").alias("root"), "artifact").distinct()
    out = None
    for depth in range(1, levels + 1):
        step = at.join(claims, "artifact").join(known, "bound_to", "left")
        fault = F.when(F.col("_is").isNull(), "missing").when(~F.col("_is").eqNullSafe(F.col("_says")), "hash")
        fault = F.coalesce(fault, F.lit("deep")) if depth == levels else fault
        step = step.select("root", "artifact", "bound_to", fault.alias("fault"))
        broken = step.where("fault is not null").select("root", F.lit(depth).alias("depth"), "artifact", "bound_to", "fault")
        out = broken if out is None else out.union(broken)
        at = step.where("fault is null").select("root", F.col("bound_to").alias("artifact")).distinct()
    first = out.groupBy("root").agg(F.min(F.struct("depth", "artifact", "bound_to", "fault")).alias("x"))
    return first.select("root", "x.*")
