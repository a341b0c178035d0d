"""Raw token caches as a Spark data source: flat files of 16- or 32-bit integers, with a metadata file that binds them.

A cache of a split is an ordered list of flat little-endian files, one for each writing task, and ``<split>.meta.json``, which names
them with lengths and digests. Tasks write under names of their own; the commit puts the metadata file in place by one rename, so
that tokens and metadata change together, and a failed write leaves the old cache as it was. One file is the classic flat cache.
Reading is by byte ranges. Paths are local or any that pyarrow's file systems know; no token passes the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

KIND, VERSION = "token-stream", "1.0"
DTYPES = {"uint16": ("<u2", 65_535), "int32": ("<i4", 2_147_483_647)}
BLOCK, RANGE_BYTES, CHUNK = 4096, 32 << 20, 1 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def self_hash(meta: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in meta.items() if k != "metadata_sha256"}).encode()).hexdigest()


def hash_of_parts(parts: list[dict]) -> str:
    return hashlib.sha256("".join(p["sha256"] for p in parts).encode()).hexdigest()


def read_metadata(path: str, split: str) -> dict:
    fs, base = located(path)
    with fs.open_input_stream(f"{base}/{split}.meta.json") as f:
        return json.loads(f.read())


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.File


@dataclass
class _Range(InputPartition):
    part: int
    name: str
    begin: int  # bytes
    end: int
    first: int  # position of the first token in the whole stream


@dataclass
class _Written(WriterCommitMessage):
    order: int
    name: str
    tokens: int
    max_id: int
    sha256: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.digest = options["path"], options["split"], options.get("mode") == "digest"
        self.block = int(options.get("block", BLOCK))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        meta, out, first = read_metadata(self.path, self.split), [], 0
        self.dtype = DTYPES[meta["dtype"]][0]
        step = max(1, self.range_bytes // (self.block * np.dtype(self.dtype).itemsize)) * self.block * np.dtype(self.dtype).itemsize
        for k, part in enumerate(meta["parts"]):
            for begin in [0] if self.digest else range(0, part["bytes"], step):
                end = part["bytes"] if self.digest else min(begin + step, part["bytes"])
                out.append(_Range(k, part["name"], begin, end, first + begin // np.dtype(self.dtype).itemsize))
            first += part["tokens"]
        return out

    def read(self, p: _Range | None) -> Iterator[pa.RecordBatch]:
        if p is None:
            return
        fs, base = located(self.path)
        full = f"{base}/{p.name}"
        if self.digest:
            if not _exists(fs, full):
                return
            digest, size = hashlib.sha256(), 0
            with fs.open_input_stream(full) as f:
                while body := f.read(CHUNK):
                    digest.update(body)
                    size += len(body)
            yield pa.RecordBatch.from_arrays([pa.array([p.part], pa.int32()), pa.array([p.name]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["part", "name", "n_bytes", "sha256"])
            return
        meta_type = DTYPES[read_metadata(self.path, self.split)["dtype"]][0]
        step = self.block * np.dtype(meta_type).itemsize * max(1, CHUNK // (self.block * np.dtype(meta_type).itemsize))
        with fs.open_input_file(full) as f:
            f.seek(p.begin)
            at, place = p.first, p.begin
            while place < p.end:
                body = f.read(min(step, p.end - place))
                if len(body) < min(step, p.end - place):
                    raise ValueError(f"{p.name} is shorter than its metadata says")
                ids = np.frombuffer(body, meta_type).astype(np.int32)
                cuts = np.append(np.arange(0, len(ids), self.block), len(ids)).astype(np.int32)
                starts = at + cuts[:-1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), p.part, np.int32)), pa.array(starts), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))], ["part", "start", "ids"])
                place, at = place + len(body), at + len(ids)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.split, self.dtype = options["path"], options["split"], options.get("dtype", "uint16")
        if self.dtype not in DTYPES:
            raise ValueError(f"a token stream is of one of {sorted(DTYPES)}")
        self.bindings = {k: json.loads(options.get(k, "{}")) for k in ("source", "tokenizer")}
        self.run = uuid.uuid4().hex
        fs, base = located(self.path)
        if not overwrite and _exists(fs, f"{base}/{self.split}.meta.json"):
            raise FileExistsError(f"there is a cache of split {self.split} already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, base = located(self.path)
        fs.create_dir(base, recursive=True)
        kind, top = DTYPES[self.dtype]
        name = f"{self.split}-{self.run}-{uuid.uuid4().hex[:12]}.{self.dtype}"
        digest, tokens, most = hashlib.sha256(), 0, -1
        with fs.open_output_stream(f"{base}/{name}") as f:
            for batch in iterator:
                ids = batch.column("ids").flatten()
                if ids.null_count:
                    raise ValueError("a token id is null")
                ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(ids):
                    continue
                if ids.min() < 0 or ids.max() > top:
                    raise ValueError(f"a token id does not fit {self.dtype}")
                body = ids.astype(kind).tobytes()
                digest.update(body)
                f.write(body)
                tokens, most = tokens + len(ids), max(most, int(ids.max()))
        return _Written(TaskContext.get().partitionId(), name, tokens, most, digest.hexdigest())

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = located(self.path)
        fs.create_dir(base, recursive=True)
        width = np.dtype(DTYPES[self.dtype][0]).itemsize
        done = sorted((m for m in messages if m), key=lambda m: m.order)
        parts = [{"name": m.name, "tokens": m.tokens, "bytes": m.tokens * width, "sha256": m.sha256} for m in done]
        meta = {"kind": KIND, "version": VERSION, "split": self.split, "dtype": self.dtype, "endianness": "little", "token_count": sum(m.tokens for m in done), "max_id": max([-1, *(m.max_id for m in done)]), "parts": parts, "cache_sha256": hash_of_parts(parts), **self.bindings}
        meta["metadata_sha256"] = self_hash(meta)
        place = f"{base}/{self.split}.meta.json"
        with fs.open_output_stream(f"{place}.{self.run}.tmp") as f:
            f.write(json.dumps(meta, sort_keys=True, indent=2).encode())
        fs.move(f"{place}.{self.run}.tmp", place)
        self._sweep(fs, base, {m.name for m in done})

    def abort(self, messages: list[_Written | None]) -> None:
        fs, base = located(self.path)
        if fs.get_file_info(base).type == pafs.FileType.Directory:
            for x in fs.get_file_info(pafs.FileSelector(base)):
                if self.run in x.base_name:
                    fs.delete_file(x.path)

    def _sweep(self, fs: pafs.FileSystem, base: str, keep: set[str]) -> None:
        """Files of the split that the new metadata does not name: the old cache, and failed attempts."""
        for x in fs.get_file_info(pafs.FileSelector(base)):
            parts = x.base_name.rsplit("-", 2)
            if len(parts) == 3 and parts[0] == self.split and x.base_name not in keep:
                fs.delete_file(x.path)


class TokenStream(DataSource):
    """``spark.read.format("token_stream")`` with options path and split: part, start (position of the block's first token in the
    whole stream) and ids. Option mode=digest: part, name, n_bytes, sha256 of each file that is there."""

    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return "part int, name string, n_bytes long, sha256 string" if self.options.get("mode") == "digest" else "part int, start long, ids array<int>"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def write_stream(coded: DataFrame, path: str, split: str, dtype: str = "uint16", source: dict | None = None, tokenizer: dict | None = None, force: bool = False) -> dict:
    """Writes the ids of all rows, in the order of the frame's partitions, and gives the metadata. An existing cache is an error
    unless forced; an id that does not fit, too, and then the old cache stays.

    source: sha256, size_bytes, encoded_bytes, requested_max_bytes, encoding, newline_aligned_prefix of what was encoded.
    tokenizer: artifact_sha256, vocab_size, special_tokens, special_token_ids.
    """
    if "-" in split or "/" in split:
        raise ValueError("a split's name is one word")
    coded.sparkSession.dataSource.register(TokenStream)
    out = coded.select(F.col("ids").cast("array<long>").alias("ids")).write.format("token_stream").mode("overwrite" if force else "append")
    out.options(path=path, split=split, dtype=dtype, source=json.dumps(source or {}), tokenizer=json.dumps(tokenizer or {})).save()
    return read_metadata(path, split)


def read_stream(spark: SparkSession, path: str, split: str, block: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """part, start, ids: blocks of the stream. A file that is shorter than the metadata says is an error."""
    spark.dataSource.register(TokenStream)
    return spark.read.format("token_stream").options(path=path, split=split, block=str(block), range_bytes=str(range_bytes)).load()


def stream_violations(spark: SparkSession, path: str, split: str, dtype: str | None = None, source: dict | None = None, tokenizer: dict | None = None) -> DataFrame:
    """check, expected, found: a row for each way in which a cache is not what its metadata says, or its metadata not what is
    wanted. Files are hashed in tasks, one each. source, tokenizer: only the bindings that are named are compared."""
    meta = read_metadata(path, split)
    width = np.dtype(DTYPES[meta["dtype"]][0]).itemsize if meta.get("dtype") in DTYPES else 0
    parts = meta["parts"]
    rules = [
        ("kind", KIND, meta.get("kind")),
        ("version", VERSION, meta.get("version")),
        ("split", split, meta.get("split")),
        ("dtype", dtype or meta.get("dtype"), meta.get("dtype") if width else f"unknown: {meta.get('dtype')}"),
        ("endianness", "little", meta.get("endianness")),
        ("token_count", sum(p["tokens"] for p in parts), meta.get("token_count")),
        ("cache_sha256", hash_of_parts(parts), meta.get("cache_sha256")),
        ("metadata_sha256", self_hash(meta), meta.get("metadata_sha256")),
        *[(f"source.{k}", v, meta.get("source", {}).get(k)) for k, v in (source or {}).items()],
        *[(f"tokenizer.{k}", v, meta.get("tokenizer", {}).get(k)) for k, v in (tokenizer or {}).items()],
    ]
    bound = meta.get("source", {})
    if bound and bound.get("encoded_bytes", 0) > bound.get("size_bytes", 0):
        rules.append(("source.encoded_bytes", f"at most {bound.get('size_bytes', 0)}", bound["encoded_bytes"]))
    told = lambda x: x if isinstance(x, str) or x is None else json.dumps(x)
    broken = spark.createDataFrame([(c, told(a), told(b)) for c, a, b in rules if a != b], "check string, expected string, found string")
    if not width:
        return broken
    spark.dataSource.register(TokenStream)
    there = spark.read.format("token_stream").options(path=path, split=split, mode="digest").load().select("part", "n_bytes", "sha256")
    named = spark.createDataFrame([(k, p["name"], p["tokens"] * width, p["sha256"]) for k, p in enumerate(parts)], "part int, name string, want_bytes long, want_sha256 string")
    both = named.join(there, "part", "left")
    fault = lambda c, a, b: F.struct(F.lit(c).alias("check"), a.cast("string").alias("expected"), b.cast("string").alias("found"))
    wrong = F.array_compact(
        F.array(
            F.when(F.col("n_bytes").isNull(), fault("file", F.col("name"), F.lit(None))),
            F.when(F.col("n_bytes") != F.col("want_bytes"), fault("bytes", F.col("want_bytes"), F.col("n_bytes"))),
            F.when(F.col("sha256") != F.col("want_sha256"), fault("sha256", F.col("want_sha256"), F.col("sha256"))),
        )
    )
    return broken.union(both.select(F.explode(wrong).alias("w")).select("w.check", "w.expected", "w.found"))
