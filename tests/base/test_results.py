"""Bindings of results, checkpoints and vocabularies."""

import json

import pytest

from corpusloom.operators import bpe, results
from corpusloom.sources import token_stream as S


def test_binding(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([([1, 2],), ([3],)], "ids array<int>")
    for s in ("train", "validation"):
        S.write_stream(rows, path, s, source={"sha256": "s", "encoded_bytes": 5, "size_bytes": 9}, tokenizer={"artifact_sha256": "t"})
    knobs = {"seed": 1, "batch_size": 2, "sequence_length": 8, "token_budget": 100}
    got = results.cache_binding(spark, path, "t", knobs, "v1")
    train = S.read_metadata(path, "train")
    assert got["train_cache_sha256"] == train["cache_sha256"] and got["validation_cache_metadata_sha256"] == S.read_metadata(path, "validation")["metadata_sha256"]
    assert (got["gradient_accumulation_steps"], got["amp"], got["seed"], got["data_version"]) == (1, {"enabled": False}, 1, "v1")
    assert [tuple(r) for r in results.cache_records(spark, path, ["train"]).collect()] == [("train", 3, 5, "s", "t")]
    with pytest.raises(ValueError, match="not bound"):
        results.cache_binding(spark, path, "other", knobs)
    with pytest.raises(KeyError):
        results.cache_binding(spark, path, "t", {"seed": 1})
    (tmp_path / train["parts"][0]["name"]).write_bytes(b"\0\0")
    with pytest.raises(ValueError, match="sha256"):
        results.cache_binding(spark, path, "t", knobs)


def test_checkpoints(spark):
    kind = "checkpoint string, type string, version string, model_config string, tokenizer_sha256 string, train_metadata_sha256 string, validation_metadata_sha256 string"
    rows = spark.createDataFrame([("a", "dense", "1.0", '{"b": 1, "a": 2}', "t", "x", "y"), ("b", "moe", "2.0", '{"a": 3}', None, "x", "z")], kind)
    wanted = {"type": "dense", "version": "1.0", "model_config": {"a": 2, "b": 1}, "tokenizer_sha256": "t", "train_metadata_sha256": "x", "validation_metadata_sha256": "y"}
    got = {(r.checkpoint, r.check) for r in results.checkpoint_violations(rows, wanted).collect()}
    assert got == {("b", c) for c in ("type", "version", "model_config", "tokenizer_sha256", "validation_metadata_sha256")}


def test_vocabulary_record():
    model = bpe.Tokenizer(bpe.learn_merges({b"ab": 3}, 300), ["<e>"])
    got = results.tokenizer_metadata(model, 300, "s", {"b": 1, "a": 2})
    assert (got["requested_vocab_size"], got["actual_vocab_size"], got["merge_count"], got["special_token_ids"]) == (300, 258, 1, {"<e>": 0})
    assert got["config_sha256"] == results.tokenizer_metadata(model, 300, "s", {"a": 2, "b": 1})["config_sha256"]
    assert json.loads(json.dumps(got)) == got
    assert results.safe_component("run-1.json") == "run-1.json"
    for bad in ("", ".", "..", "a/b", "../x", "a\\b", "-x"):
        with pytest.raises(ValueError):
            results.safe_component(bad)
