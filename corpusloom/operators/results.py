"""Records of results: the caches and tokenizers they were made with, what binds them, and documents that a schema accepts."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import token_stream
from .gate import compiled


def cache_records(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """split, token_count, encoded_bytes, source_sha256, tokenizer_sha256 of caches, as results carry them."""
    rows = []
    for s in splits:
        m = token_stream.read_metadata(path, s)
        rows.append((s, m["token_count"], m["source"].get("encoded_bytes"), m["source"].get("sha256"), m["tokenizer"].get("artifact_sha256")))
    return spark.createDataFrame(rows, "split string, token_count long, encoded_bytes long, source_sha256 string, tokenizer_sha256 string")


#: The settings that a binding names beside its hashes.
KNOBS = ("seed", "batch_size", "sequence_length", "token_budget", "gradient_accumulation_steps", "optimizer", "scheduler", "amp")
KNOB_DEFAULTS = {"gradient_accumulation_steps": 1, "optimizer": {"name": "AdamW"}, "scheduler": {"name": "not_run"}, "amp": {"enabled": False}}


def cache_binding(spark: SparkSession, path: str, tokenizer_sha256: str, settings: dict, data_version: str | None = None, splits: tuple[str, ...] = ("train", "validation")) -> dict:
    """What a result is bound to: digests of the tokenizer, and of each split's tokens and metadata, and the run's settings.
    Caches are verified first, file by file in tasks; a cache that is not what it says, or of another tokenizer, is an error."""
    out = {"data_version": data_version, "tokenizer_sha256": tokenizer_sha256}
    for s in splits:
        broken = token_stream.stream_violations(spark, path, s, tokenizer={"artifact_sha256": tokenizer_sha256}).limit(3).collect()
        if broken:
            raise ValueError(f"the cache of split {s} is not bound: {[tuple(b) for b in broken]}")
        meta = token_stream.read_metadata(path, s)
        out |= {f"{s}_cache_metadata_sha256": meta["metadata_sha256"], f"{s}_cache_sha256": meta["cache_sha256"]}
    return out | {k: settings[k] if k in settings else KNOB_DEFAULTS[k] for k in KNOBS}


def checkpoint_violations(checkpoints: DataFrame, wanted: dict) -> DataFrame:
    """checkpoint, check, expected, found: a row for each field that differs. checkpoints: checkpoint (its name), type, version,
    model_config (JSON), tokenizer_sha256, train_metadata_sha256, validation_metadata_sha256. wanted: the same fields; those not
    given are not compared. Configurations are compared as JSON values."""
    from .transcript import canonical

    rows = []
    for c, value in wanted.items():
        expected = F.lit(value if isinstance(value, str) or value is None else json.dumps(value))
        found = F.col(c).cast("string")
        same = canonical(found).eqNullSafe(canonical(expected)) if c == "model_config" else found.eqNullSafe(expected)
        rows.append(F.when(~same, F.struct(F.lit(c).alias("check"), expected.alias("expected"), found.alias("found"))))
    return checkpoints.select("checkpoint", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("checkpoint", "x.*")


def safe_component(name: str) -> str:
    """A name that is one part of a path and nothing else."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError(f"not one part of a path: {name!r}")
    return name


def tokenizer_metadata(tokenizer, requested_vocab: int, source_sha256: str, config: dict) -> dict:
    """The record of a trained vocabulary: requested and actual sizes, merges, special tokens, digests of artifact, source and
    configuration. Fewer tokens than requested is no error: the corpus had no more pairs."""
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {
        "requested_vocab_size": requested_vocab,
        "actual_vocab_size": len(tokenizer.tokens),
        "merge_count": len(tokenizer.merges),
        "special_tokens": tokenizer.specials,
        "special_token_ids": {s: i for i, s in enumerate(tokenizer.specials)},
        "artifact_sha256": hashlib.sha256(canonical(tokenizer.body()).encode()).hexdigest(),
        "source_sha256": source_sha256,
        "config_sha256": hashlib.sha256(canonical(config).encode()).hexdigest(),
    }


def assembled(runs: DataFrame, points: DataFrame, caches: DataFrame, schema: dict, run: str = "run") -> DataFrame:
    """run, body (JSON), errors: a document for each run: its own columns, its curve (points by step, at the run's logged
    steps, so bounded) and its caches by split, checked by a schema. A run without points or caches has empty lists."""
    curve = points.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("curve"), F.max_by("loss", "step").alias("final_loss"))
    cached = caches.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("split", *[c for c in caches.columns if c not in (run, "split")]))).alias("caches"))
    rows = runs.join(curve, run, "left").join(cached, run, "left")
    lists = {c: F.coalesce(c, F.from_json(F.lit("[]"), rows.schema[c].dataType)) for c in ("curve", "caches")}
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.withColumns(lists).select(run, body.alias("body")).withColumn("errors", compiled(schema)(F.col("body")))
