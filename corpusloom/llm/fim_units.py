r"""Operator 13: fill-in-the-middle by relational units.

Method. A text is cut into units (runs of letters, and every other character). The units are rows: their lengths are summed up by
a window in the order of their ordinals, requests for cuts are joined by ordinal, the offsets are aggregated for each document,
and the text is cut there by substring.

Units are taken in two steps, so that there are few rows: first blocks of BLOCK units, exploded with their lengths; then the units
of the blocks in which a cut falls. Only blocks up to the last cut are exploded. Rows that texts are cut into carry a number of
their document's row, which is fixed as the table of blocks is written; so repeated rows stay apart, and no key is hot. Offsets are
joined back by a digest of id and text, with one row for each digest. Texts are shuffled once, in that join; texts that stay plain
are not.

All steps are built-in functions; a join's hot digest (one document repeated) is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._scratch import Scratch

UNIT = r"[A-Za-z]+|[^A-Za-z]"
BLOCK = 32
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Percent of documents that stay plain, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def draws(key: str, seed: int = 1) -> list[Column]:
    """Four numbers below 2 ** 32 for each key, from a digest of seed and key; a null key counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def stays_plain(body: Column, draw: Column) -> Column:
    marked = [body.contains(m) for m in MARKS.values()]
    return (body == "") | marked[0] | marked[1] | marked[2] | (draw % 100 >= 100 - PLAIN)


def _n_units(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def block_table(docs: DataFrame) -> DataFrame:
    """row, key, n, low, high (units before the first and the second cut), block (ordinal), length, and units: the text of a
    block in which a cut falls. docs: key, body, h1, h2, none of them empty. Write it before use, as rows are numbered here."""
    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("blocks", F.regexp_extract_all("body", F.lit(f"(?:{UNIT}){{1,{BLOCK}}}+"), F.lit(0)))
    rows = rows.select("row", "key", "h1", "h2", "blocks", ((F.size("blocks") - 1) * BLOCK + _n_units(F.element_at("blocks", -1))).alias("n"))
    cut = lambda h: F.col(h) % (F.col("n") + 1)
    rows = rows.select("row", "key", "blocks", "n", F.least(cut("h1"), cut("h2")).alias("low"), F.greatest(cut("h1"), cut("h2")).alias("high"))
    upto = F.greatest(F.lit(1), F.ceil(F.col("high") / BLOCK)).cast("int")
    rows = rows.select("row", "key", "n", "low", "high", F.posexplode_outer(F.slice("blocks", 1, upto)).alias("block", "text"))
    asked = (F.col("block") == _block_of("low")) | (F.col("block") == _block_of("high"))
    return rows.select("row", "key", "n", "low", "high", "block", F.char_length("text").alias("length"), F.when(asked, F.col("text")).alias("units"))


def _block_of(cut: str) -> Column:
    """The block of the last unit before a cut; -1 if there is none."""
    return F.floor((F.col(cut) - 1) / BLOCK).cast("int")


def cut_offsets(blocks: DataFrame) -> DataFrame:
    """key, n, at_low, at_high: code points before the cuts of each document."""
    # a cut is asked of the block of its last unit, with the text of that block; one before all units of the first block
    cuts = F.filter(F.array_distinct(F.array("low", "high")), lambda c: F.greatest(F.floor((c - 1) / BLOCK), F.lit(0)) == F.col("block"))
    requests = blocks.where("units is not null or block = 0").select("row", "block", "key", "n", "low", "high", "units", F.explode(cuts).alias("cut"))
    running = W.partitionBy("row").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    lengths = blocks.select("row", "block", "length", (F.col("units").isNotNull() | (F.col("block") == 0)).alias("asked"))
    before = lengths.select("row", "block", "asked", F.coalesce(F.sum("length").over(running), F.lit(0)).alias("before")).where("asked").drop("asked")
    asked = requests.join(before, ["row", "block"])
    # the units before the cut in its block; a cut before all units has none
    inside = F.when(F.col("cut") > 0, F.slice(F.regexp_extract_all("units", F.lit(UNIT), F.lit(0)), 1, ((F.col("cut") - 1) % BLOCK + 1).cast("int")))
    units = asked.select("row", "block", "cut", "key", "n", "low", "high", "before", F.posexplode_outer(inside).alias("unit", "text"))
    upto = W.partitionBy("row", "block", "cut").orderBy("unit").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = units.select("key", "n", "low", "high", "cut", "unit", (F.col("before") + F.sum(F.char_length("text")).over(upto)).alias("at"))
    last = summed.where(F.col("unit").isNull() | (F.col("unit") == (F.col("cut") - 1) % BLOCK))
    at = lambda c: F.coalesce(F.max(F.when(F.col("cut") == F.col(c), F.col("at"))), F.lit(0)).cast("int")
    # equal keys are equal documents, so any of their rows will do
    return last.groupBy("key").agg(F.max("n").alias("n"), at("low").alias("at_low"), at("high").alias("at_high"))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    p, s, m = (F.lit(MARKS[k]) for k in ("prefix", "suffix", "middle"))
    return F.when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of, by its marks alone, which such a text does not contain."""
    p, s, m = (MARKS[k] for k in ("prefix", "suffix", "middle"))

    def between(a: str, b: str | None) -> Column:
        begin = F.instr(output, a) + len(a)
        return F.substring(output, begin, F.instr(output, b) - begin) if b else F.substring(output, begin, F.char_length(output))

    spm = F.concat(between(p, m), between(m, None), between(s, p))
    psm = F.concat(between(p, s), between(m, None), between(s, m))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (text), for each row.

    A null text counts as empty and stays plain, as does a text with a mark in it. A null id draws as the word null. Repeated
    rows have equal results, one each. Other columns are not read. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.select("doc_id", "body", *[h.alias(f"h{i + 1}") for i, h in enumerate(draws("doc_id", seed))])
    plain = rows.where(stays_plain(F.col("body"), F.col("h3")))
    none = F.lit(None).cast("long")
    kept = plain.select("doc_id", _n_units(F.col("body")).alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("body").alias("output"))
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "body")))
    cut = rows.where(~stays_plain(F.col("body"), F.col("h3"))).withColumn("key", digest)
    blocks = Scratch(docs.sparkSession, "op13").keep(block_table(cut.select("key", "body", "h1", "h2")))
    both = cut.select("doc_id", "body", "key", F.when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form")).join(cut_offsets(blocks), "key")
    middle = F.col("at_high") - F.col("at_low")
    output = assembled(F.col("form"), F.substring("body", F.lit(1), F.col("at_low")), F.substring("body", F.col("at_low") + 1, middle), F.substring("body", F.col("at_high") + 1, F.char_length("body")))
    return kept.union(both.select("doc_id", "n", "form", F.col("at_low").cast("long"), middle.cast("long"), output))


def op13_fim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


SQL = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '{UNIT}') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM a),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {100 - PLAIN} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, array_to_string(u[:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM d
"""
