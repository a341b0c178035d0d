"""Comparison tables: deltas of backends, curves, timings, seeds, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backend_delta(runs: DataFrame, keys: list[str], backend: str, metric: str, base: str, other: str) -> DataFrame:
    """keys, base, other, delta_pct: the change in percent; null where one is missing or the base is 0."""
    wide = runs.groupBy(*keys).agg(*[F.max(F.when(F.col(backend) == b, F.col(metric))).alias(n) for b, n in ((base, "base"), (other, "other"))])
    return wide.withColumn("delta_pct", (F.col("other") - F.col("base")) / F.abs(F.nullif(F.col("base"), F.lit(0.0))) * 100)


def delta_text(delta: Column) -> Column:
    """Two decimals, blank for null."""
    return F.coalesce(F.format_string("%.2f", delta), F.lit(""))


def curve_summary(points: DataFrame, keys: list[str], step: str, loss: str, pos: str) -> DataFrame:
    """First and last value by place, least value with its earliest step, changes and count; NaN and null are left out."""
    ok = points.where(~F.isnan(loss) & F.col(loss).isNotNull())
    return (
        ok.groupBy(*keys)
        .agg(
            F.min_by(loss, pos).alias("first"),
            F.max_by(loss, pos).alias("last"),
            F.min(F.struct(F.col(loss).alias("v"), F.col(step).alias("s"))).alias("_m"),
            F.count("*").alias("n"),
        )
        .select(*keys, "first", "last", F.col("_m.v").alias("least"), F.col("_m.s").alias("least_step"), (F.col("last") - F.col("first")).alias("change"), (F.col("last") - F.col("_m.v")).alias("above_least"), "n")
    )


def curve_points(curves: DataFrame, key: str, column: str) -> DataFrame:
    """key, step, value of a map with numbers as text keys; other keys are left out."""
    rows = curves.select(key, F.explode(column).alias("k", "value"))
    return rows.select(key, F.expr("try_cast(k as bigint)").alias("step"), "value").where("step is not null")


def logged_steps(points: DataFrame, step: str, every: int, last: int) -> DataFrame:
    return points.where((F.col(step) % every == 0) | (F.col(step) == last))


def timing(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """n, ms_per_item and items_per_s; 0 where nothing or no time was taken."""
    sums = df.groupBy(*keys).agg(F.count(seconds).alias("n"), F.sum(seconds).alias("s"))
    return sums.select(*keys, "n", F.coalesce(F.try_divide(F.col("s") * 1000, F.col("n").cast("double")), F.lit(0.0)).alias("ms_per_item"), F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("s")), F.lit(0.0)).alias("items_per_s"))


def seed_summary(runs: DataFrame, config: str, seed: str, value: str) -> DataFrame:
    """Means and population standard deviations over seeds, with the seeds that are there."""
    return runs.groupBy(config).agg(F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.array_join(F.array_sort(F.collect_list(F.col(seed).cast("string"))), ",").alias("seeds"))


def routing_totals(layers: DataFrame, keys: list[str], assigned: str, dropped: str, tokens: int) -> DataFrame:
    """Sums of per-expert counts over layers, dropped tokens, imbalance (most / mean), and the dropped share of one layer's
    tokens and of all layers'."""
    per = layers.select(*keys, dropped, F.posexplode(assigned).alias("expert", "c")).groupBy(*keys, "expert").agg(F.sum("c").alias("c"))
    load = per.groupBy(*keys).agg(F.sum("c").alias("assigned"), (F.max("c") / F.avg("c")).alias("imbalance"))
    lost = layers.groupBy(*keys).agg(F.sum(dropped).alias("dropped"), F.count("*").alias("n_layers"))
    both = load.join(lost, keys) if keys else load.crossJoin(lost)
    return both.withColumns({"dropped_of_layer": F.col("dropped") / tokens, "dropped_of_all": F.col("dropped") / (F.col("n_layers") * tokens)})


def nearest(rows: DataFrame, keys: list[str], name: str, options: list[tuple[str, float]], target: Column) -> DataFrame:
    """keys, name: of a few options (name, value) the one whose value is nearest to a target of the key's rows; of equals the
    least name. Rows are not multiplied by options: each option's least distance is a number to aggregate. The shuffle comes first, so
    that no task holds the keys of a whole file."""
    far = [F.min(F.abs(F.lit(v) - F.col("_t"))).alias(f"_{i}") for i, (_, v) in enumerate(options)]
    least = rows.select(*keys, target.alias("_t")).repartition(*keys).groupBy(*keys).agg(*far)
    best = F.array_min(F.array(*[F.struct(F.col(f"_{i}").alias("d"), F.lit(n).alias("n")) for i, (n, _) in enumerate(options)]))
    return least.select(*keys, best["n"].alias(name))


def loss_totals(losses: DataFrame, keys: list[str], loss: str, encoded_bytes: Column) -> DataFrame:
    """n_tokens, mean loss, perplexity and nats a byte; losses that are not finite are left out and counted."""
    fine = ~F.isnan(loss) & (F.abs(loss) != float("inf"))
    sums = losses.groupBy(*keys).agg(F.count(F.when(fine, 1)).alias("n_tokens"), F.sum(F.when(fine, F.col(loss))).alias("total"), F.count(F.when(~fine, 1)).alias("n_bad"))
    return sums.withColumns({"mean_loss": F.try_divide("total", F.col("n_tokens").cast("double")), "perplexity": F.exp(F.try_divide("total", F.col("n_tokens").cast("double"))), "nats_per_byte": F.try_divide(F.col("total"), encoded_bytes.cast("double"))})


#: The fields of a record of losses, in their groups.
MODEL_FIELDS = ("model_id", "model_short", "model_local_dir", "source_hub", "hf_revision", "tokenizer_revision", "local_snapshot_revision", "dtype", "device", "seq_len", "elapsed_seconds", "key_file_sha256")
CACHE_FIELDS = ("cache_sha256", "source_sha256", "source_bytes", "evaluated_bytes", "encoded_tokens")
LOSS_FIELDS = ("revision_verified", "evaluated_tokens", "sum_loss_nats", "mean_loss_nats", "perplexity", "loss_nats_per_source_byte", "loss_nats_per_evaluated_byte", "owt_sha256")


def loss_records(models: DataFrame, caches: DataFrame, losses: DataFrame, loss: str, source_sha256: str) -> DataFrame:
    """A record of 25 fields for each model: what it is (MODEL_FIELDS), the cache that it was run on (CACHE_FIELDS, by
    model_short), and its losses (by model_short; those that are not finite are left out), with the digest that the source
    should have. A model without losses has zero tokens and a null mean. revision_verified: is the local snapshot's
    revision the one that was asked for?"""
    sums = loss_totals(losses, ["model_short"], loss, F.lit(1)).select("model_short", F.col("n_tokens").alias("evaluated_tokens"), F.col("total").alias("sum_loss_nats"), F.col("mean_loss").alias("mean_loss_nats"), "perplexity")
    rows = models.select(*MODEL_FIELDS).join(caches.select("model_short", *CACHE_FIELDS), "model_short", "left").join(sums, "model_short", "left")
    rows = rows.withColumns({"evaluated_tokens": F.coalesce("evaluated_tokens", F.lit(0)), "revision_verified": F.coalesce(F.col("hf_revision") == F.col("local_snapshot_revision"), F.lit(False)), "owt_sha256": F.lit(source_sha256)})
    per = F.try_divide(F.col("sum_loss_nats"), F.greatest(F.lit(1), F.col("evaluated_bytes")).cast("double"))
    rows = rows.withColumns({"loss_nats_per_source_byte": F.try_divide(F.col("sum_loss_nats"), F.greatest(F.lit(1), F.col("source_bytes")).cast("double")), "loss_nats_per_evaluated_byte": per})
    return rows.select(*MODEL_FIELDS, *CACHE_FIELDS, *LOSS_FIELDS)


def first_batches(losses: DataFrame, keys: list[str], batch: str, loss: str, n: int) -> DataFrame:
    """keys, n_batches, mean loss of the batches numbered 0 to n - 1; an error if there is none at all."""
    first = losses.where(F.col(batch) < n)
    if first.isEmpty():
        raise ValueError("no batch to take a mean of")
    return first.groupBy(*keys).agg(F.count("*").alias("n_batches"), F.avg(loss).alias("mean_loss"))


def histogram_shares(counts: DataFrame, totals: DataFrame, keys: list[str], name: str, n: str, total: str) -> DataFrame:
    """keys, name, n summed over files, and its share of all files' totals, as those without a count of that name are in it."""
    sums = counts.groupBy(*keys, name).agg(F.sum(n).alias("n"))
    whole = totals.groupBy(*keys).agg(F.sum(total).alias("_t"))
    both = sums.join(whole, keys) if keys else sums.crossJoin(F.broadcast(whole))  # one row
    return both.withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("_t").cast("double"))).drop("_t")


def named_like(rows: DataFrame, name: str, parts: list[str] | None) -> DataFrame:
    """The rows whose name holds any of the parts; all rows if none is given."""
    if not parts:
        return rows
    return rows.where(F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(F.col(name), x)))


def resolved_names(models: DataFrame, short: str, full: str, names: list[str] | None) -> DataFrame:
    """The models asked for by their short or, failing that, full name, numbered as asked (pos); all, unnumbered, if none is
    asked for. An unknown name is an error."""
    if not names:
        return models.withColumn("pos", F.lit(None).cast("long"))
    asked = models.sparkSession.createDataFrame(list(enumerate(names)), "pos long, _asked string")
    by_short = asked.join(models, F.col("_asked") == F.col(short))
    rest = asked.join(models.select(F.col(short).alias("_asked")), "_asked", "left_anti")
    by_full = rest.select("pos", "_asked").join(models, F.col("_asked") == F.col(full))
    unknown = rest.join(models.select(F.col(full).alias("_asked")), "_asked", "left_anti").collect()  # of the names given
    if unknown:
        raise ValueError(f"unknown names: {sorted(r['_asked'] for r in unknown)}")
    return by_short.unionByName(by_full).select(*models.columns, "pos")
