"""Operator 2 [native]: deduplication of lines by content-defined chunks.

Method. Every line is hashed; a rolling hash over the hashes of three lines marks the lines after which a chunk ends, so
that boundaries depend on what stands near them and come back after an insertion. A passage in one line (of LONG words or
more) is always a chunk of its own. Of the chunks that come more than once in all documents, those of two lines or more and
the long ones are compared by their bytes; all but the first occurrence are removed (least doc_id, then text, then place).

With ``passages`` every repeated run of two lines or more with over PASSAGE words is found too, whatever its neighbours:
from each line that is not blank, the shortest such run forwards and the shortest backwards are candidates as well. A
repeated run holds the forward one of its first line, the backward one of its last line, and those between cover the rest.
A run can only be repeated if each of its lines is, so lines are counted first, and runs are made of repeated lines alone.
The query op2_line_dedup and its SQL are without it.

Scale. First only 64-bit hashes of chunks (and lines) are shuffled and counted, with partial sums. A filter made of the
repeated ones picks the chunks whose text is shuffled for the comparison; a hot chunk is one row for each task in the
aggregation, and in the join its rows are dealt out over several tasks. Texts of documents are shuffled only where something
may be removed from them. All expressions are built-in; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch, carried, flag_keys, hot_values, only_keys, spread_join

LONG = 40  # words
SPARSE = 4  # one line in so many ends a chunk
PASSAGE = 50  # words that a run of lines has more than
_B = 256

_STEPS = (
    # lines and their hashes (28 bits, so that sums stay in 64 bits), and which are long
    {"_l": "split(coalesce(text, ''), '\\n', -1)"},
    {"_h": "transform(_l, x -> cast(conv(left(md5(x), 7), 16, 10) as bigint))", "_w": f"transform(_l, x -> length(x) - length(replace(x, ' ', '')) >= {LONG - 1})", "_n": "size(_l)"},
    {"_a": "concat(array(0L), slice(_h, 1, _n - 1))", "_b": "slice(concat(array(0L, 0L), _h), 1, _n)", "_v": "concat(slice(_w, 2, _n - 1), array(true))"},
    {"_e": f"filter(transform(arrays_zip(_h, _a, _b, _w, _v), (x, i) -> if(x._w or x._v or (x._h + 31 * x._a + 961 * x._b) % 1000003 % {SPARSE} = 0, i + 1, 0)), x -> x > 0)"},
    {"_c": "transform(arrays_zip(concat(array(0), slice(_e, 1, size(_e) - 1)), _e), x -> named_struct('begin', x['0'], 'end', x._e))"},
)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _k: which occurrence of a text this is."""
    return docs.withColumn("_k", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))))


def _chunked(docs: DataFrame) -> DataFrame:
    """docs with _k, _l (lines) and _c (chunks: first line, end)."""
    df = _keyed(docs)
    for step in _STEPS:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df


#: From _x, the repeated lines that are not blank: place among those that are not blank (r), among all lines (i), words (q).
_RUNS = (
    {"_m": "size(_x)"},
    # sums of words by blocks and up to each line
    {"_s": f"transform(sequence(0, _m div {_B}), b -> aggregate(slice(_x, 1, b * {_B}), 0, (a, x) -> a + x.q))"},
    {"_p": f"transform(sequence(0, _m), i -> _s[i div {_B}] + aggregate(slice(_x, i div {_B} * {_B} + 1, i % {_B}), 0, (a, x) -> a + x.q))"},
    # each run's first line and end; each line has a word, which bounds a run
    {
        "_f": f"transform(sequence(0, _m), i -> struct(i as a, i + greatest(2, 1 + size(filter(slice(_p, i + 2, {PASSAGE + 1}), x -> x - _p[i] <= {PASSAGE}))) as z))",
        "_g": f"transform(sequence(0, _m), i -> struct(i - greatest(2, 1 + size(filter(slice(_p, greatest(i - {PASSAGE}, 1), least(i, {PASSAGE + 1})), x -> _p[i] - x <= {PASSAGE}))) as a, i as z))",
    },
    # with no line between that is not repeated
    {"_x": "transform(filter(array_distinct(concat(_f, _g)), x -> x.a >= 0 and x.z <= _m and _x[x.z - 1].r - _x[x.a].r = x.z - 1 - x.a), x -> named_struct('begin', _x[x.a].i, 'end', _x[x.z - 1].i + 1))"},
)


def _runs(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """A row for each shortest run of repeated lines that can be a passage: doc_id, _k, begin, end, body."""
    docs = _keyed(docs)
    # lines that are not blank, with their number; _l for one text only at a time
    lines = docs.select("_k", F.expr("filter(transform(split(coalesce(text, ''), '\\n', -1), (x, i) -> named_struct('i', i, 'x', x)), l -> rlike(l.x, '[^\\\\x20\\\\x09-\\\\x0D]'))").alias("_l"))
    lines = lines.select("_k", F.posexplode_outer("_l").alias("r", "l")).where("r is not null")
    lines = lines.select("_k", "r", F.col("l.i").alias("i"), F.xxhash64("l.x").alias("hash"), F.expr("size(filter(split(l.x, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''))").alias("q"))
    twice = scratch.keep(lines.groupBy("hash").count().where("count > 1").select("hash"))
    some = only_keys(lines, "hash", twice, "hash").select("_k", "r", "i", "q").distinct()
    found = some.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("r", "i", "q"))).alias("_x"))
    for step in _RUNS:
        found = found.withColumns({k: F.expr(v) for k, v in step.items()})
    # no condition on _x before it is written: the optimiser would put all that it is made of in place of each mention
    found = scratch.keep(found.select("_k", "_x")).where("size(_x) > 0")
    texts = only_keys(docs, "_k", found, "_k").select("doc_id", "_k", F.expr("split(coalesce(text, ''), '\\n', -1)").alias("_l"))
    rows = texts.join(found, "_k").select("doc_id", "_k", "_l", F.explode_outer("_x").alias("c")).where("c is not null")
    return rows.select("doc_id", "_k", "c.begin", "c.end", F.expr("array_join(slice(_l, c.begin + 1, c.end - c.begin), '\\n')").alias("body"))


def _bodies(docs: DataFrame) -> DataFrame:
    """A row for each chunk that can be a passage: doc_id, _k, begin, end, body.

    The outer form of explode, though no text is without a chunk: for the other one the optimiser makes a filter of all that
    the chunks are computed from, once more for each mention.
    """
    rows = _chunked(docs).select("doc_id", "_k", "_l", "_w", F.explode_outer("_c").alias("c"))
    rows = rows.where("c.end - c.begin > 1 or _w[c.begin]").select("doc_id", "_k", "c.begin", "c.end", F.expr("array_join(slice(_l, c.begin + 1, c.end - c.begin), '\\n')").alias("body"))
    return rows.where(F.col("body").rlike("[^\\x20\\x09-\\x0D]"))


def repeated_chunks(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(_k, gone): the chunks to remove from each text that has any, as an array of (begin, end)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    bodies = _bodies(docs).union(_runs(scratch, docs)) if passages else _bodies(docs)
    hashes = scratch.keep(bodies.select(F.xxhash64("body").alias("hash")).groupBy("hash").count().where("count > 1").select("hash"))
    some = only_keys(bodies.withColumn("hash", F.xxhash64("body")), "hash", hashes, "hash")
    some = scratch.keep(some.withColumn("at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "begin")))
    first = some.groupBy("hash", "body").agg(F.min("at").alias("first"))
    gone = spread_join(some, first, ["hash", "body"], "hash", hot_values(some, "hash"), F.col("_k")).where("not (at <=> first)")
    if passages:  # runs may overlap; where one overlaps the first of its kind, that stays whole
        gone = gone.withColumn("begin", F.expr("if(at._k = first._k and begin < first.begin + end - begin, first.begin + end - begin, begin)")).where("begin < end")
    out = scratch.keep(gone.groupBy("_k").agg(F.collect_set(F.struct("begin", "end")).alias("gone")))
    scratch.drop(some, hashes)
    return out


def dedup_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """The rows of docs with new text (without the removed chunks) and the columns n_lines, n_removed_lines, n_removed_chunks.

    docs needs doc_id and text; its other columns stay, whatever their names, but for those that have the new columns' names,
    which are replaced. Null texts stay null and have no lines; an empty text has one line. Blank chunks are never removed.
    Rows of one doc_id and text are the same occurrence: they lose the same chunks. Null ids come last. If every line goes,
    the text is empty. An empty table gives an empty result. With ``passages``, n_removed_chunks counts the runs of removed
    lines.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    # the caller's columns travel in one, so that none can clash with those made here
    row = carried(docs)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = repeated_chunks(docs.select("doc_id", "text"), passages)
    rows = flag_keys(_chunked(docs).select(row, "doc_id", "text", "_k", "_l", "_n", "_c"), "_k", gone, "_k", "_some")
    hit = rows.where("_some").join(gone, "_k", "left").withColumn("gone", F.expr("coalesce(gone, array())"))
    clean = rows.where("not _some").withColumn("gone", F.expr("cast(array() as array<struct<begin: int, end: int>>)"))
    kept = F.expr("filter(_c, x -> not array_contains(gone, x))")
    out = hit.select(*clean.columns).unionByName(clean).withColumn("_r", kept).withColumn("_some", F.expr("size(gone) > 0"))
    if passages:
        # the removed lines, and as chunks of which nothing is removed the others
        out = out.withColumn("_d", F.expr("array_sort(array_distinct(flatten(transform(gone, x -> sequence(x.begin, x.end - 1)))))"))
        out = out.withColumn("_r", F.expr("if(_some, transform(array_except(sequence(0, _n - 1), _d), i -> named_struct('begin', i, 'end', i + 1)), _c)"))
        out = out.withColumn("gone", F.expr("zip_with(filter(_d, (x, i) -> i = 0 or _d[i - 1] < x - 1), filter(_d, (x, i) -> i = size(_d) - 1 or _d[i + 1] > x + 1), (a, b) -> named_struct('begin', a, 'end', b + 1))"))
    new = {
        "doc_id": F.col("doc_id"),
        "text": F.expr("if(_some, array_join(transform(_r, x -> array_join(slice(_l, x.begin + 1, x.end - x.begin), '\\n')), '\\n'), text)"),
    }
    return out.select(
        *[new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in names],
        F.expr("if(text is null, 0L, cast(size(_l) as bigint))").alias("n_lines"),
        F.expr("aggregate(gone, 0L, (a, x) -> a + x.end - x.begin)").alias("n_removed_lines"),
        F.expr("cast(size(gone) as bigint)").alias("n_removed_chunks"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def sql(source: str = "documents") -> str:
    return rf"""
WITH a AS (SELECT row_number() OVER () AS r, *, string_split(coalesce(text, ''), chr(10)) AS l,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS k FROM {source}),
b AS (SELECT r, doc_id, k, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM a),
c AS (SELECT *, ('0x' || left(md5(line), 7))::BIGINT AS h, length(line) - length(replace(line, ' ', '')) >= {LONG - 1} AS long FROM b),
d AS (SELECT *, (h + 31 * lag(h, 1, 0) OVER w + 961 * lag(h, 2, 0) OVER w) % 1000003 % {SPARSE} = 0 OR long OR lead(long, 1, true) OVER w AS stop
  FROM c WINDOW w AS (PARTITION BY r ORDER BY i)),
e AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM d),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(k) AS k, j, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS m, bool_or(long) AS long FROM e GROUP BY r, j),
g AS (SELECT *, (m > 1 OR long) AND regexp_matches(body, '[^\x20\x09-\x0D]') AND
    dense_rank() OVER (PARTITION BY body, (m > 1 OR long) ORDER BY doc_id NULLS LAST, k, j) > 1 AS gone FROM f),
h AS (SELECT r, string_agg(body, chr(10) ORDER BY j) FILTER (NOT gone) AS text, sum(m) AS n, sum(m) FILTER (gone) AS x, count(*) FILTER (gone) AS y FROM g GROUP BY r)
"""


SQL = (
    sql()
    + "SELECT a.doc_id, CASE WHEN a.text IS NULL THEN 0 ELSE CAST(n AS BIGINT) END AS n_lines, CAST(coalesce(x, 0) AS BIGINT) AS n_removed_lines, y AS n_removed_chunks, sha256(coalesce(h.text, '')) AS kept_sha256 FROM a JOIN h USING (r)"
)
