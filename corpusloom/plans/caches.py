"""Queries through raw token caches. Token ids are the lengths of a document's pieces between spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import token_stream as S
from ..sources.shared import shared_folder
from . import query, table

_IDS = "SELECT doc_id, text, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents WHERE text IS NOT NULL"


def _coded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    ordered = docs.repartitionByRange(6, "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return ordered.select(F.transform(F.split("text", " ", -1), F.char_length).alias("ids"), F.octet_length("text").alias("n"))


@query(f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, ids FROM ({_IDS})), t AS (SELECT r, generate_subscripts(ids, 1) AS i, unnest(ids) AS id FROM d), p AS (SELECT row_number() OVER (ORDER BY r, i) - 1 AS pos, id FROM t)
SELECT dtype, count(*) AS n_tokens, CAST(sum(id) AS BIGINT) AS total, CAST(max(id) AS BIGINT) AS max_id, CAST(sum(pos % 1000 * id) AS BIGINT) AS by_place FROM p, (SELECT unnest(['uint16', 'int32']) AS dtype) GROUP BY dtype""")
def token_stream_round_trip(spark, sf_dir):
    """All documents written as streams of both types and read back by ranges; by_place shows that the order is kept."""
    path, out = shared_folder(spark, "streams"), None
    for dtype in S.DTYPES:
        S.write_stream(_coded(spark, sf_dir), path, dtype, dtype)
        at = S.read_stream(spark, path, dtype, range_bytes=1 << 20).select("start", F.posexplode("ids").alias("i", "id"))
        one = at.agg(F.count("*").alias("n_tokens"), F.sum("id").alias("total"), F.max("id").cast("long").alias("max_id"), F.sum((F.col("start") + F.col("i")) % 1000 * F.col("id")).alias("by_place")).select(F.lit(dtype).alias("dtype"), "*")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH s AS (SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(ids)) AS BIGINT) AS n FROM ({_IDS}))
SELECT 'source.size_bytes' AS "check", CAST(bytes + 1 AS VARCHAR) AS expected, CAST(bytes AS VARCHAR) AS found FROM s
UNION ALL SELECT 'tokenizer.artifact_sha256', 'other', 'one' UNION ALL SELECT 'tokenizer.vocab_size', CAST(n AS VARCHAR), NULL FROM s UNION ALL SELECT 'dtype', 'int32', 'uint16'""")
def token_stream_violations(spark, sf_dir):
    """A cache against bindings of which four are not its own."""
    coded = _coded(spark, sf_dir)
    size, n = coded.agg(F.sum("n"), F.sum(F.size("ids"))).first()
    path = shared_folder(spark, "streams")
    S.write_stream(coded, path, "train", source={"size_bytes": size, "encoded_bytes": size, "encoding": "utf-8"}, tokenizer={"artifact_sha256": "one"})
    return S.stream_violations(spark, path, "train", dtype="int32", source={"size_bytes": size + 1, "encoding": "utf-8"}, tokenizer={"artifact_sha256": "other", "vocab_size": n})
