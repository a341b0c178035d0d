"""Raw token caches: round trips, atomic replacement, and a row for each way to be wrong."""

import json
import os

import numpy as np
import pytest

from corpusloom.sources import token_stream as S


def coded(spark, rows, parts=3):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, ids array<int>").repartitionByRange(parts, "i").sortWithinPartitions("i").select("ids")


def tokens(frame):
    out = {}
    for r in frame.collect():
        out.update({r.start + i: x for i, x in enumerate(r.ids)})
    assert sorted(out) == list(range(len(out)))
    return [out[i] for i in range(len(out))]


def found(spark, path, split="train", **want):
    return {tuple(r) for r in S.stream_violations(spark, path, split, **want).collect()}


@pytest.mark.parametrize("dtype", ["uint16", "int32"])
def test_round_trip(spark, tmp_path, dtype):
    rows = [[i % 65_536, 65_535, 0] * (i % 40) for i in range(300)] + [None, []]
    meta = S.write_stream(coded(spark, rows), str(tmp_path), "train", dtype)
    flat = [x for r in rows for x in r or ()]
    assert meta["token_count"] == len(flat) and meta["max_id"] == 65_535
    assert b"".join((tmp_path / p["name"]).read_bytes() for p in meta["parts"]) == np.array(flat, S.DTYPES[dtype][0]).tobytes()
    assert tokens(S.read_stream(spark, str(tmp_path), "train", block=7, range_bytes=100)) == flat
    assert tokens(S.read_stream(spark, f"file://{tmp_path}", "train")) == flat
    assert found(spark, str(tmp_path), dtype=dtype) == set()


def test_a_failed_write_leaves_the_old_cache(spark, tmp_path):
    path = str(tmp_path)
    old = S.write_stream(coded(spark, [[1, 2], [3]]), path, "train")
    S.write_stream(coded(spark, [[9]]), path, "dev")
    with pytest.raises(Exception, match="cache of split train"):
        S.write_stream(coded(spark, [[5]]), path, "train")
    for bad in ([70_000], [-1]):
        with pytest.raises(Exception, match="does not fit uint16"):
            S.write_stream(coded(spark, [[4], [5], bad]), path, "train", force=True)
    assert S.read_metadata(path, "train") == old and tokens(S.read_stream(spark, path, "train")) == [1, 2, 3]
    assert found(spark, path) == set()
    new = S.write_stream(coded(spark, [[70_000]]), path, "train", "int32", force=True)
    left = {x for x in os.listdir(path) if x.startswith("train-") and not x.endswith(".crc")}
    assert left == {p["name"] for p in new["parts"]}
    assert tokens(S.read_stream(spark, path, "train")) == [70_000] and tokens(S.read_stream(spark, path, "dev")) == [9]


def test_empty_cache(spark, tmp_path):
    assert S.write_stream(coded(spark, [[1]]).where("false"), str(tmp_path), "train")["token_count"] == 0
    assert tokens(S.read_stream(spark, str(tmp_path), "train")) == []


def test_violations(spark, tmp_path):
    path, place = str(tmp_path), tmp_path / "train.meta.json"
    source = {"sha256": "s", "size_bytes": 10, "encoded_bytes": 9, "requested_max_bytes": None, "encoding": "utf-8", "newline_aligned_prefix": True}
    tokenizer = {"artifact_sha256": "t", "vocab_size": 300, "special_tokens": ["<a>"], "special_token_ids": {"<a>": 1}}
    meta = S.write_stream(coded(spark, [[1, 2, 3], [4]], 1), path, "train", source=source, tokenizer=tokenizer)
    assert found(spark, path, source=source, tokenizer=tokenizer) == set()
    assert {x[0] for x in found(spark, path, source={"sha256": "x", "requested_max_bytes": 5}, tokenizer={"special_tokens": []})} == {"source.sha256", "source.requested_max_bytes", "tokenizer.special_tokens"}
    name = meta["parts"][0]["name"]
    body = (tmp_path / name).read_bytes()
    (tmp_path / name).write_bytes(body[:-2] + b"\x05\x00")
    assert {x[0] for x in found(spark, path)} == {"sha256"}
    (tmp_path / name).write_bytes(body[:-2])
    assert {x[0] for x in found(spark, path)} == {"sha256", "bytes"}
    with pytest.raises(Exception, match="shorter"):
        S.read_stream(spark, path, "train").collect()
    (tmp_path / name).unlink()
    assert found(spark, path) == {("file", name, None)}
    (tmp_path / name).write_bytes(body)
    for change, checks in (
        ({"token_count": 5}, {"token_count", "metadata_sha256"}),
        ({"kind": "other", "version": "9"}, {"kind", "version", "metadata_sha256"}),
        ({"cache_sha256": "0", "split": "dev"}, {"cache_sha256", "split", "metadata_sha256"}),
        ({"endianness": "big"}, {"endianness", "metadata_sha256"}),
        ({"dtype": "int8"}, {"dtype", "metadata_sha256"}),
        ({"source": {**source, "encoded_bytes": 11}}, {"source.encoded_bytes", "metadata_sha256"}),
    ):
        place.write_text(json.dumps({**meta, **change}))
        assert {x[0] for x in found(spark, path)} == checks
