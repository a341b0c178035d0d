"""Conversations: turns, prompts, well-formed transcripts, calls and their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def last_user_turn(turns: DataFrame) -> DataFrame:
    """conv_id, text of the last user turn that is not blank."""
    said = turns.where("role = 'user' and trim(text) <> ''")
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def last_answer(turns: DataFrame, has_calls: Column | None = None) -> DataFrame:
    """conv_id, turn, text of the last assistant turn that has no calls and a text that is not empty. A conversation without
    one has no row."""
    said = turns.where((F.col("role") == "assistant") & (F.col("text") != "") & ~F.coalesce(has_calls if has_calls is not None else F.lit(False), F.lit(False)))
    last = said.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("_x"))
    return last.select("conv_id", "_x.turn", "_x.text")


def without_last_answers(turns: DataFrame, has_calls: Column | None = None) -> DataFrame:
    """Drops all assistant turns without calls at the end of each conversation."""
    plain = (F.col("role") == "assistant") & ~F.coalesce(has_calls if has_calls is not None else F.lit(False), F.lit(False))
    last = turns.groupBy("conv_id").agg(F.max(F.when(~plain, F.col("turn"))).alias("_l"))
    return turns.join(last, "conv_id").where("turn <= _l").drop("_l")


def without_last_answer(turns: DataFrame, has_calls: Column | None = None) -> DataFrame:
    """Drops one assistant turn at the end of each conversation, calls or not; with ``has_calls`` only one without calls."""
    plain = (F.col("role") == "assistant") & ~F.coalesce(has_calls if has_calls is not None else F.lit(False), F.lit(False))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_l"))
    return turns.join(last, "conv_id").where(~((F.col("turn") == F.col("_l")) & plain)).drop("_l")


def joined(turns: DataFrame, line: Column, sep: str, tail: str = "") -> DataFrame:
    """conv_id, prompt: the lines of a conversation in order. A conversation is one row: its length is bounded by a model's
    context."""
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))).alias("x"))
    return lines.select("conv_id", F.concat(F.array_join(F.transform("x", lambda x: x["s"]), sep), F.lit(tail)).alias("prompt"))


HEADS = {"user": "### User", "assistant": "### Assistant", "tool": "### Result"}


def render_prompt(turns: DataFrame, has_calls: Column | None = None) -> DataFrame:
    """System turns and a last assistant turn without calls go; each turn has a header; one for the assistant's answer is last."""
    kept = without_last_answer(turns.where("role <> 'system'"), has_calls)
    head = F.coalesce(*[F.when(F.col("role") == r, F.lit(h)) for r, h in HEADS.items()])
    return joined(kept.where(F.col("role").isin(*HEADS)), F.concat(head, F.lit("\n"), "text"), "\n\n", "\n\n### Assistant\n")


def render_plain(turns: DataFrame, all_roles: bool = False) -> DataFrame:
    """Fallback without a template: ``role: text`` lines; with all roles, a header for the answer is last."""
    kept = turns if all_roles else turns.where(F.col("role").isin("user", "assistant", "system"))
    return joined(kept, F.concat("role", F.lit(": "), "text"), "\n", "\nassistant:" if all_roles else "")


def turn_faults(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_gaps, n_repeats (equal roles in a row, system aside), last_role."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"_p": F.lag("turn").over(w), "_r": F.lag("role").over(w)})
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sum(F.when(F.col("turn") != F.coalesce(F.col("_p") + 1, F.lit(0)), 1).otherwise(0)).cast("long").alias("n_gaps"),
        F.sum(F.when((F.col("role") == F.col("_r")) & (F.col("role") != "system"), 1).otherwise(0)).cast("long").alias("n_repeats"),
        F.max_by("role", "turn").alias("last_role"),
    )


def kth_answers(asked: DataFrame, answered: DataFrame, key: str, order: str, id_: str) -> DataFrame:
    """key, k, the ids of the k-th question and the k-th answer, and fits: is the answer there, and later?"""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order, id_))
    a = asked.select(key, rank.alias("k"), F.col(id_).alias("asked_id"), F.col(order).alias("_a"))
    b = answered.select(key, rank.alias("k"), F.col(id_).alias("answer_id"), F.col(order).alias("_b"))
    fits = F.coalesce((F.col("_b") > F.col("_a")) & F.col("asked_id").isNotNull(), F.lit(False))
    return a.join(b, [key, "k"], "full_outer").select(key, F.col("k").cast("long").alias("k"), "asked_id", "answer_id", fits.alias("fits"))


def dependency_faults(calls: DataFrame, sample: str = "sample_id", call: str = "call_id", pos: str = "pos", deps: str = "depends_on") -> DataFrame:
    """A row for each fault: duplicate id, dangling, self or not earlier dependency. Edges that all point back have no
    cycle, so cycles need no search."""
    seen = calls.groupBy(sample, call).agg(F.min(pos).alias("_p"), F.count("*").alias("_n"))
    twice = seen.where("_n > 1").select(sample, call, F.lit(None).cast("string").alias("dep"), F.lit("duplicate_id").alias("fault"))
    edges = calls.select(sample, call, pos, F.explode(deps).alias("dep"))
    to = edges.join(seen.select(sample, F.col(call).alias("dep"), "_p"), [sample, "dep"], "left")
    fault = F.when(F.col("dep") == F.col(call), "self").when(F.col("_p").isNull(), "dangling").when(F.col("_p") >= F.col(pos), "not_earlier")
    return twice.union(to.select(sample, call, "dep", fault.alias("fault")).where("fault is not null"))


def mismatched_calls(declared: DataFrame, issued: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Issued calls whose id is not declared, or with another name or other arguments than declared."""
    d = declared.select(sample, "call_id", F.col("name").alias("_n"), F.col("arguments").alias("_a"))
    both = issued.join(d, [sample, "call_id"], "left")
    fault = F.when(F.col("_n").isNull(), "unknown_id").when(F.col("_n") != F.col("name"), "name").when(~F.col("_a").eqNullSafe(F.col("arguments")), "arguments")
    return both.withColumn("fault", fault).where("fault is not null").drop("_n", "_a")
