"""Corpus tables: lines, word and pair counts, byte-budget prefixes, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import pretokens


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line with its line end, n_bytes. A last line without an end is a line."""
    lines = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", F.octet_length("line").cast("long").alias("n_bytes"))


def word_table(docs: DataFrame, *keys: str) -> DataFrame:
    """How often each pretoken comes: counted within tasks before the only shuffle."""
    return docs.select(*keys, F.explode(pretokens(F.col("text"))).alias("tok")).groupBy(*keys, "tok").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent pairs of bytes, as hex digits: each distinct pair of a word once, weighted by the word's count. Hex digits sort
    as the bytes do."""
    places = F.sequence(F.lit(0), F.octet_length("tok") - 2)
    both = F.transform(places, lambda i: F.substr(F.col("x"), 2 * i + 1, F.lit(4)))
    pairs = words.where(F.octet_length("tok") > 1).withColumn("x", F.hex("tok")).select(F.explode(F.array_distinct(both)).alias("p"), "n")
    sums = pairs.groupBy("p").agg(F.sum("n").alias("n"))
    return sums.select(F.left("p", F.lit(2)).alias("left_byte"), F.right("p", F.lit(2)).alias("right_byte"), "n")


def running_total(df: DataFrame, order: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """df with the running total of value in the order of an integer column.

    Sums of blocks of the order column give each block's offset; they are summed up within wider blocks, and those within the
    whole, in a table with a row for each ``block`` squared numbers. So no task sees all rows, or a row for each block.
    """
    df = df.withColumn("_b", F.floor(F.col(order) / block))
    sums = df.groupBy("_b").agg(F.sum(value).alias("_s")).withColumn("_c", F.floor(F.col("_b") / block))
    wide = sums.groupBy("_c").agg(F.sum("_s").alias("_t"))
    wide = wide.select("_c", (F.sum("_t").over(W.orderBy("_c")) - F.col("_t")).alias("_w"))
    near = sums.withColumn("_o", F.sum("_s").over(W.partitionBy("_c").orderBy("_b")) - F.col("_s"))
    before = near.join(wide, "_c").select("_b", (F.col("_o") + F.col("_w")).alias("_o"))
    inner = F.sum(value).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_i", inner).join(before, "_b").withColumn(name, F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def byte_prefix(docs: DataFrame, max_bytes: int) -> DataFrame:
    """The first documents, by doc_id, that fit into the budget. It ends before the first one that does not fit."""
    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return running_total(sized, "doc_id", "n_bytes", "cum_bytes").where(F.col("cum_bytes") <= max_bytes)


def prefix_bytes(docs: DataFrame, max_bytes: int) -> DataFrame:
    """n_docs, n_bytes of that prefix; zeros where not even the first document fits."""
    return byte_prefix(docs, max_bytes).agg(F.count("*").alias("n_docs"), F.coalesce(F.max("cum_bytes"), F.lit(0)).alias("n_bytes"))


def duplicates(docs: DataFrame) -> DataFrame:
    """sha, first_id, n of every text that comes more than once."""
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
