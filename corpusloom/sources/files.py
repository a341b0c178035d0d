"""Files in: JSON documents, transcripts, lines, token caches. Tables out: token caches, samples, manifests, CSV.

All go through Spark's readers and writers, so any store that Spark reads will do. Writers refuse to replace what is there
unless told to, and Spark's commit leaves an old output alone when a job fails before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import digest_contents, digest_ids, digest_sources


def json_documents(spark: SparkSession, *paths: str, id_field: str = "id") -> DataFrame:
    """path, id, body (variant), raw of each JSON file; a document without an id has its file's stem. Splits that are not
    named are not read."""
    files = spark.read.text(list(paths), wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    body = F.try_parse_json("value")
    stem = F.regexp_replace("name", r"\.json$", "")
    return files.select("path", F.coalesce(F.try_variant_get(body, f"$.{id_field}", "string"), stem).alias("id"), body.alias("body"), F.col("value").alias("raw"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, row (JSON): the last row of each sample of ``{"rows": [...]}`` files; rows without an id go."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.rows"), "array<string>")).alias("pos", "row"))
    rows = raw.withColumn("sample_id", F.get_json_object("row", "$.sample_id")).where("coalesce(sample_id, '') <> ''")
    return rows.groupBy("sample_id").agg(F.max_by("row", "pos").alias("row"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files, with their line ends as they are; ``line_table`` cuts them."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of a manifest whose file is missing or has another digest."""
    return manifest.join(files.select("path", F.col("sha256").alias("found")), "path", "left").where("not (sha256 <=> found)")


def ints_of(blob: Column, dtype: str = "<u2") -> Column:
    """The integers of a raw little-endian token stream."""
    if dtype not in ("<u2", "<i4"):
        raise ValueError("token streams have 16-bit unsigned or 32-bit signed integers")

    @F.pandas_udf("array<int>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype).astype(np.int32))

    return run(blob)


def blob_of(ids: Column, dtype: str = "<u2") -> Column:
    """A raw little-endian token stream; an id that does not fit is an error."""
    top = {"<u2": 65_535, "<i4": 2_147_483_647}[dtype]

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            a = np.asarray(x, np.int64)
            if len(a) and (a.min() < 0 or a.max() > top):
                raise ValueError("a token id does not fit the stream's type")
            return a.astype(dtype).tobytes()

        return rows.map(one)

    return run(ids)


def write_token_cache(coded: DataFrame, path: str, split: str, tokenizer_sha256: str, force: bool = False) -> DataFrame:
    """Writes doc_id, ids as Parquet under split=<split> of path/tokens, and a metadata row under path/meta; gives the row."""
    mode = "overwrite" if force else "errorifexists"
    coded.write.mode(mode).parquet(f"{path}/tokens/split={split}")
    back = coded.sparkSession.read.parquet(f"{path}/tokens/split={split}")
    meta = back.agg(
        F.lit(split).alias("split"),
        F.lit("token-cache").alias("kind"),
        F.lit(1).alias("version"),
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("token_count"),
        F.coalesce(F.max(F.array_max("ids")), F.lit(0)).alias("max_id"),
        F.lit(tokenizer_sha256).alias("tokenizer_sha256"),
    )
    meta.coalesce(1).write.mode(mode).parquet(f"{path}/meta/split={split}")
    return coded.sparkSession.read.parquet(f"{path}/meta/split={split}")


def read_token_cache(spark: SparkSession, path: str, split: str, tokenizer_sha256: str) -> DataFrame:
    """The cache's rows, after its metadata row agrees with what is wanted and with the rows."""
    meta = spark.read.parquet(f"{path}/meta/split={split}").first()
    tokens = spark.read.parquet(f"{path}/tokens/split={split}")
    count = tokens.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    if (meta.kind, meta.version, meta.tokenizer_sha256, meta.token_count) != ("token-cache", 1, tokenizer_sha256, count):
        raise ValueError("the token cache is of another kind, tokenizer or length")
    return tokens


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    samples.write.mode(mode).partitionBy("split").json(path)


DIGESTS = {"content": digest_contents, "ids": digest_ids}


def write_manifest(entries: DataFrame, path: str, key: str, kinds: list[str], digest: str = "content", mode: str = "errorifexists") -> DataFrame:
    """Writes the entries and a header row (split, count of each kind, 0 included, digest); gives the header."""
    entries.write.mode(mode).json(f"{path}/entries")
    counts = entries.groupBy("split").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    one = digest_sources(entries, "source", key) if digest == "source" else DIGESTS[digest](entries, key)
    header = counts.crossJoin(F.broadcast(one))  # one row
    header.coalesce(1).write.mode(mode).json(f"{path}/header")
    return header


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """A small table as one CSV file with a header and fixed columns."""
    df.select(*columns).coalesce(1).write.mode(mode).csv(path, header=True)


def new_only(df: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows whose key is not in the output yet: resuming a job without doing work again."""
    try:
        done = spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return df
    return df.join(done, key, "left_anti")


def seed_files(spark: SparkSession, pattern: str, root: str = "") -> DataFrame:
    """One row for each JSON file of a seed, with its path. The pattern is absolute or below root; none found is an error."""
    full = pattern if pattern.startswith("/") or "://" in pattern else f"{root.rstrip('/')}/{pattern}"
    path = spark._jvm.org.apache.hadoop.fs.Path(full)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        raise ValueError(f"no file matches {full}")
    return spark.read.json(full, multiLine=True).withColumn("path", F.input_file_name())


def settings(supplied: dict, configured: dict, defaults: dict) -> dict:
    """What was given on the command line, else what the configuration has, else the default."""
    return defaults | configured | {k: v for k, v in supplied.items() if v is not None}


def load_settings(path: str) -> dict:
    """A run's configuration from a JSON file, or from a YAML file of one level: nested blocks and lists are an error, as are
    lines without a value."""
    import json
    import re

    with open(path, encoding="utf-8") as f:
        body = f.read()
    try:
        return json.loads(body)
    except ValueError:
        pass
    out = {}
    for n, line in enumerate(body.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#") or line.strip() in ("---", "..."):
            continue
        name, colon, value = line.partition(":")
        value = re.sub(r"(^|\s)#.*$", "", value).strip() if not value.strip().startswith(("'", '"')) else value.strip()
        if line[0].isspace() or line.startswith("-") or not colon or not value or value in ("|", ">"):
            raise ValueError(f"{path}, line {n}: only names with plain values are read, no blocks or lists: {line.strip()}")
        try:
            out[name.strip()] = json.loads(value)
        except ValueError:
            out[name.strip()] = {"~": None, "yes": True, "no": False}.get(value, value.strip("'\""))
    return out
