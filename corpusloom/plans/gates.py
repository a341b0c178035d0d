"""Queries through the schema gate and the guards of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate
from ..sources.shared import shared_folder
from . import query, table

SCHEMA = {
    "type": "object",
    "required": ["k", "who"],
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "who": {"$ref": "#/$defs/name"}, "tags": {"type": "array", "items": {"type": "string", "minLength": 2}, "uniqueItems": True}},
    "additionalProperties": False,
    "$defs": {"name": {"enum": ["click", "view", "purchase"]}},
}
_BODY = """CASE WHEN event_id % 18 = 0 THEN '[1]' WHEN event_id % 9 = 0 THEN '{broken' ELSE '{"k": ' || json_extract_string(props, '$.k') || CASE event_id % 7 WHEN 1 THEN '.5' WHEN 2 THEN '.0' ELSE '' END || CASE event_id % 5 WHEN 1 THEN '' ELSE ', "who": "' || event_type || '"' END
  || CASE event_id % 6 WHEN 1 THEN ', "tags": ["ab", "ab", "c"]' WHEN 2 THEN ', "more": null' ELSE '' END || '}' END"""


@query(f"""WITH e AS (SELECT *, {_BODY} AS body, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
x AS (SELECT event_id, body, CASE WHEN event_id % 18 = 0 THEN ['$: type'] WHEN event_id % 9 = 0 THEN ['$: json'] ELSE list_filter([CASE WHEN event_id % 5 = 1 THEN '$.who: required' END,
  CASE WHEN event_id % 7 = 1 THEN '$.k: type' WHEN k < 10 THEN '$.k: minimum' WHEN k > 90 THEN '$.k: maximum' END, CASE WHEN event_id % 5 <> 1 AND event_type NOT IN ('click', 'view', 'purchase') THEN '$.who: enum' END,
  CASE WHEN event_id % 6 = 1 THEN '$.tags: uniqueItems' END, CASE WHEN event_id % 6 = 1 THEN '$.tags[2]: minLength' END, CASE WHEN event_id % 6 = 2 THEN '$.more: additionalProperties' END], lambda y: y IS NOT NULL) END AS errors FROM e)
SELECT event_id, array_to_string(list_sort(errors), ', ') AS errors, CASE WHEN len(errors) = 0 THEN 'accepted' ELSE 'quarantine' END AS part FROM x""")
def schema_gate(spark, sf_dir):
    """Events' properties, some of them broken, written through the gate and read back with the part they went to."""
    e = F.col("event_id")
    body = F.concat(
        F.lit('{"k": '),
        F.get_json_object("props", "$.k"),
        F.when(e % 7 == 1, ".5").when(e % 7 == 2, ".0").otherwise(""),
        F.when(e % 5 == 1, "").otherwise(F.concat(F.lit(', "who": "'), "event_type", F.lit('"'))),
        F.when(e % 6 == 1, ', "tags": ["ab", "ab", "c"]').when(e % 6 == 2, ', "more": null').otherwise(""),
        F.lit("}"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 18 == 0, "[1]").when(e % 9 == 0, "{broken").otherwise(body).alias("body"))
    path = shared_folder(spark, "gate")
    gate.gated_write(rows, gate.compiled(SCHEMA)(F.col("body")), path, most_rejected=None)
    return spark.read.parquet(path).select("event_id", F.array_join(F.array_sort("errors"), ", ").alias("errors"), "part")


@query("""WITH c AS (SELECT event_id AS sample_id, event_type AS name, props AS a FROM events WHERE event_id % 4 > 0 AND props IS NOT NULL),
r AS (SELECT DISTINCT event_type AS name, props AS a FROM events WHERE event_id % 3 = 0), s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no_tool' ELSE 'single_tool' END AS class FROM events)
SELECT event_id, class, array_to_string(list_filter([CASE WHEN class = 'no_tool' AND c.name IS NOT NULL THEN 'no_tool: calls' END, CASE WHEN class <> 'no_tool' AND c.name IS NULL THEN 'calls: none' END,
  CASE WHEN c.name IS NOT NULL AND r.name IS NULL THEN 'call: not executable' END], lambda y: y IS NOT NULL), ', ') AS errors FROM s LEFT JOIN c ON c.sample_id = event_id LEFT JOIN r ON r.name = c.name AND r.a = c.a""")
def sample_guards(spark, sf_dir):
    """Events as calls of a type's tool, results known for every third event's arguments."""
    events = table(spark, sf_dir, "events")
    calls = events.where("event_id % 4 > 0 and props is not null").select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("name"), F.concat(F.lit(" "), "props").alias("arguments"), F.lit(None).cast("string").alias("expected_result"))
    results = events.where("event_id % 3 = 0").select(F.col("event_type").alias("name"), F.col("props").alias("arguments"), F.lit("done").alias("result"))
    samples = events.select("event_id", F.when(F.col("event_id") % 5 == 0, "no_tool").otherwise("single_tool").alias("class")).withColumn("sample_id", F.col("event_id"))
    out = gate.sample_guards(samples, gate.with_results(calls, results))
    return out.select("event_id", "class", F.array_join("errors", ", ").alias("errors"))
