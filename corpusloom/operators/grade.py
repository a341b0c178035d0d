"""Three-valued grades in eight layers, rewards, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The layers in the order in which the first failure is looked for.
LAYERS = ("parse_success", "schema_valid", "tool_name_correct", "argument_value_correct", "call_plan_matches", "execution_success", "result_grounded", "final_answer_correct")


def first_failure(layers: tuple[str, ...] = LAYERS) -> Column:
    """The name of the first layer that is false; null where none is. A null layer does not apply and is passed over."""
    return F.coalesce(*[F.when(~F.col(x), F.lit(x)) for x in layers])


def layered_reward(layers: tuple[str, ...] = LAYERS) -> Column:
    """Share of the layers that apply which are true; 0 where none applies."""
    applied = F.filter(F.array(*layers), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.size(F.filter(applied, lambda x: x)).cast("double"), F.size(applied).cast("double")), F.lit(0.0))


def binary_reward(layers: tuple[str, ...] = LAYERS) -> Column:
    """1 where at least one layer applies and none that does is false."""
    applied = F.filter(F.array(*layers), lambda x: x.isNotNull())
    return F.when((F.size(applied) > 0) & ~F.exists(applied, lambda x: ~x), 1.0).otherwise(0.0)


def dominant_reward(parse_success: Column, first: Column) -> Column:
    """Which of four channels a reward comes from. A transcript whose parse layer is not true, also where it is null, is the
    parser's; then the first failure decides: none, that of the answer, or any other."""
    parsed = F.coalesce(parse_success, F.lit(False))
    return F.when(~parsed, "parse_success").when(first == "final_answer_correct", "final_answer_correct").when(first.isNull(), "execution_correct").otherwise("argument_correct")


def graded(df: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    return df.withColumns({"first_failure": first_failure(layers), "reward_binary": binary_reward(layers), "reward_layered": layered_reward(layers)})


def reward_summary(df: DataFrame, *by: str) -> DataFrame:
    """n, means and population standard deviations of both rewards."""
    aggs = [F.count("*").alias("n")]
    for r in ("binary", "layered"):
        aggs += [F.avg(f"reward_{r}").alias(f"{r}_mean"), F.stddev_pop(f"reward_{r}").alias(f"{r}_std")]
    return df.groupBy(*by).agg(*aggs)


def signal_summary(df: DataFrame, layers: tuple[str, ...] = LAYERS, task: str = "task_type") -> DataFrame:
    """of, value, n, binary_mean, binary_std, layered_mean, layered_std, applied_mean: all rows (of = all), those of each
    first failure ('none' where nothing failed) and of each task type ('unknown' for an empty or null one), in one scan by
    grouping sets. applied_mean is the mean number of layers that apply, the denominator of the layered reward. No rows give
    one row with n = 0 and nulls."""
    applied = F.size(F.filter(F.array(*layers), lambda x: x.isNotNull()))
    rows = df.select("reward_binary", "reward_layered", applied.alias("_applied"), F.coalesce("first_failure", F.lit("none")).alias("first_failure"), F.coalesce(F.nullif(F.col(task), F.lit("")), F.lit("unknown")).alias("task_type"))
    sums = [F.count("*").alias("n")]
    for r in ("binary", "layered"):
        sums += [F.avg(f"reward_{r}").alias(f"{r}_mean"), F.stddev_pop(f"reward_{r}").alias(f"{r}_std")]
    sums += [F.avg("_applied").alias("applied_mean"), F.grouping_id("first_failure", "task_type").alias("_g")]
    sets = rows.groupingSets([[], ["first_failure"], ["task_type"]], "first_failure", "task_type").agg(*sums)
    of = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "first_failure").otherwise("task_type")
    sets = sets.select(of.alias("of"), F.coalesce("first_failure", "task_type").alias("value"), "n", "binary_mean", "binary_std", "layered_mean", "layered_std", "applied_mean")
    # grouping sets of no rows are no rows: one row stands for all of them
    whole = df.sparkSession.range(1).select(F.lit("all").alias("of")).join(sets.where("of = 'all'"), "of", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return whole.unionByName(sets.where("of <> 'all'"))


def failure_histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, F.coalesce("first_failure", F.lit("none")).alias("first_failure")).agg(F.count("*").alias("n"))


def parse_rate(df: DataFrame, *by: str) -> DataFrame:
    """Share of transcripts that parse: a null counts as no."""
    return df.groupBy(*by).agg(F.avg(F.coalesce("parse_success", F.lit(False)).cast("int")).alias("parse_rate"))


def latest(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key; empty keys go. Maxima are made before the shuffle."""
    names = [c for c in rows.columns if c not in (key, pos)]
    best = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*names), pos).alias("_x"))
    return best.select(key, "_x.*")


def matched(samples: DataFrame, transcripts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts with their samples, and the samples' ids without a transcript."""
    return samples.join(transcripts, key), samples.select(key).join(transcripts.select(key), key, "left_anti")


def require_overlap(both: DataFrame) -> DataFrame:
    if both.isEmpty():
        raise ValueError("no transcript belongs to a sample")
    return both


def as_transcripts(rows: DataFrame) -> DataFrame:
    """rows with tool_calls and final_answer, taken from extracted_calls and generated. A column that is not there counts as
    no calls or an empty answer; a null stays null, which does not parse."""
    calls = F.col("extracted_calls") if "extracted_calls" in rows.columns else F.array().cast("array<string>")
    answer = F.col("generated") if "generated" in rows.columns else F.lit("")
    out = rows.withColumns({"tool_calls": calls, "final_answer": answer})
    return out.drop("extracted_calls", "generated")
