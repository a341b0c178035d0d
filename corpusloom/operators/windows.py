"""Token windows, routing with a capacity, advantages within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import seeded
from .ranks import ranked


def check_shape(batch: int, length: int, tokens: int) -> None:
    if batch < 1 or length < 2 or tokens < length + 1:
        raise ValueError("a batch needs a row, a window two tokens, and the stream one token more than a window")


def causal_windows(stream: DataFrame, keys: list[str], pos: str, token: str, length: int, batch: int = 1) -> DataFrame:
    """Windows that do not overlap, with targets one token on; the remainder is dropped.

    keys, window, inputs, targets. Window w starts at w * length; there are floor((n - 1) / (batch * length)) * batch of them.
    Each token goes to its own window, and a window's first token also to the one before, so a window is gathered alone.
    """
    n = stream.groupBy(*keys).agg(F.count("*").alias("_n"))
    own = stream.select(*keys, F.floor(F.col(pos) / length).alias("window"), (F.col(pos) % length).alias("_i"), token)
    next_ = own.where("_i = 0 and window > 0").withColumns({"window": F.col("window") - 1, "_i": F.lit(length)})
    items = own.union(next_).groupBy(*keys, "window").agg(F.array_sort(F.collect_list(F.struct("_i", F.col(token).alias("t")))).alias("x"))
    kept = items.join(n, keys).where(F.col("window") < F.floor((F.col("_n") - 1) / (batch * length)) * batch)
    ids = F.transform("x", lambda x: x["t"])
    return kept.select(*keys, "window", F.slice(ids, 1, length).alias("inputs"), F.slice(ids, 2, length).alias("targets"))


def random_starts(keys: DataFrame, seed: int, tokens: Column | int, length: int, *by: str) -> DataFrame:
    """A reproducible window start from 0 to tokens - length - 1 for each row, from a digest that any engine has."""
    number = F.conv(F.left(seeded(seed, F.concat_ws(":", *by)), F.lit(12)), 16, 10).cast("long")
    return keys.withColumn("start", number % ((tokens if isinstance(tokens, Column) else F.lit(tokens)) - length))


def first_rows(stream: DataFrame, keys: list[str], pos: str, token: str, length: int, batch: int) -> DataFrame:
    """keys, row (from 0), tokens: the first batch * length tokens of each stream, as batch rows. A stream that has not one token
    more than that is an error. Only tokens that are needed are shuffled."""
    need = batch * length
    short = stream.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") < need + 1)
    if not short.isEmpty():
        raise ValueError(f"a stream is shorter than {need + 1} tokens")
    own = stream.where(F.col(pos) < need).select(*keys, F.floor(F.col(pos) / length).alias("row"), F.struct(F.col(pos).alias("i"), F.col(token).alias("t")).alias("x"))
    rows = own.groupBy(*keys, "row").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(*keys, "row", F.transform("x", lambda x: x["t"]).alias("tokens"))


def scored_tokens(n: Column, length: int) -> Column:
    """Predictions over windows that start every ``length`` tokens: all tokens but the first of each."""
    return n - F.ceil((n - 1) / F.lit(length))


def route(tokens: DataFrame, expert: str, token: str, cap: Column, block: int = 4096) -> DataFrame:
    """tokens with kept: is it among the first ``cap`` tokens of its expert? Tokens are counted by expert and block of their
    numbers first, so that no task sorts all tokens of an expert; within blocks they are ranked."""
    rows = ranked(tokens, [expert], F.floor(F.col(token) / block), [token], "_rank")
    return rows.withColumn("kept", F.col("_rank") <= cap).drop("_rank")


def load_balance(df: DataFrame, expert: str, prob: str, experts: int) -> DataFrame:
    """experts * sum over experts of mean probability * share of assignments."""
    per = df.groupBy(expert).agg(F.avg(prob).alias("p"), F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("_t"))
    return per.crossJoin(total).agg((F.sum(F.col("p") * F.col("n") / F.col("_t")) * experts).alias("load_balance"))


def group_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-6) -> DataFrame:
    """(reward - mean) / population standard deviation within the group; 0 where the spread is below eps.

    Means come from an aggregation with partial sums and are joined back, so that a large group does not meet in one task.
    """
    stats = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    return df.join(stats, group).withColumn("advantage", F.when(F.col("_s") < eps, 0.0).otherwise((F.col(reward) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))).drop("_m", "_s")
