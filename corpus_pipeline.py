"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents (doc_id, text, lang, source, n_chars), with n_chars counted anew where text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.llm import bpe_verify, fm_decontam, langid, line_dedup, ngram_join
from corpusloom.llm._scratch import Scratch, flag_keys, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least score of a kept language. Sure predictions score 0.9 and more; texts between two languages 0.5.
LEAST_SCORE = 0.52


def _counted(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def _has_words() -> Column:
    return F.col("text").rlike(r"[^\x20\x09-\x0D]")


def _in_small_batches(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """df, written by jobs whose Arrow batches are small: whole batches are outside of the executor's heap, and their buffers
    are kept for later, beside a heap that is full by then."""
    with small_batches(spark):
        return Scratch(spark, name).keep(df)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that was learned, go."""
    found = langid.language_id(docs, carry=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines and repeated passages go; so do documents of which only white space is left."""
    found = line_dedup.dedup_lines(docs, passages=True)
    return _counted(found.where((F.col("n_removed_chunks") == 0) | _has_words()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the least id stays; of rows of one id, one."""
    groups = ngram_join.ngram_jaccard_join(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id")
    twice = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rows = flag_keys(docs.select(*COLUMNS), "doc_id", gone.union(twice), "doc_id", "_may")
    # only the texts of flagged rows are shuffled
    some = rows.where("_may").join(gone.distinct(), "doc_id", "left_anti").join(twice.withColumn("_twice", F.lit(True)), "doc_id", "left")
    once = some.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("text", "lang", "source"))).where("_twice is null or _r = 1")
    return once.select(*COLUMNS).union(rows.where("not _may").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which only white space is left go."""
    found = fm_decontam.fm_decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return _in_small_batches(spark, "decontamination", _counted(fm_decontam.without_spans(found).where((F.col("n_hit") == 0) | _has_words())))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded text."""
    coded = bpe_verify.bpe_encode(docs, bpe_verify.tokenizer_path())
    return _in_small_batches(spark, "encoding", bpe_verify.digests(coded, "ids"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup_), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", encode)]

#: SQL has neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
