"""Queries over conversations as tool-calling transcripts, with a fault of each kind planted by id."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import transcript as T
from . import query, table

# Calls are made of all assistant turns but the last ones, tool messages of user turns; what is planted depends on conv_id % 12.
_MADE = """
base AS (SELECT conv_id, turn, role, text, conv_id % 12 AS p, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
msg AS (SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN role = 'user' AND turn > 1 THEN CASE WHEN p = 3 THEN 'critic' ELSE 'tool' END ELSE role END AS role,
  CASE WHEN p = 10 OR asks THEN '' ELSE text END AS content, CASE WHEN asks THEN CASE WHEN (conv_id + turn) % 5 = 0 THEN ['c' || turn, 'd' || turn] ELSE ['c' || turn] END ELSE [] END AS calls,
  CASE WHEN role = 'user' AND turn > 1 AND p <> 3 THEN CASE p WHEN 1 THEN 'zz' || turn WHEN 2 THEN NULL ELSE 'c' || (turn - 1) END END AS answers, turn
  FROM (SELECT *, role = 'assistant' AND CASE p WHEN 4 THEN turn > 1 WHEN 11 THEN turn < last - 2 ELSE turn < last END AS asks FROM base)),
fin AS (SELECT conv_id, any_value(p) AS p, max(pos) FILTER (role = 'assistant' AND len(calls) = 0 AND content <> '') AS fp, max(pos) AS top, arg_max(content, pos) FILTER (role = 'assistant' AND len(calls) = 0 AND content <> '') AS said FROM msg GROUP BY conv_id)"""
_FAULT = "{'position': CAST(m.pos AS INTEGER), 'fault': '%s', 'id': %s}"


def _transcripts(spark, sf_dir):
    base = table(spark, sf_dir, "conversations").withColumns({"p": F.col("conv_id") % 12, "last": F.max("turn").over(W.partitionBy("conv_id"))})
    asks = (F.col("role") == "assistant") & F.when(F.col("p") == 4, F.col("turn") > 1).when(F.col("p") == 11, F.col("turn") < F.col("last") - 2).otherwise(F.col("turn") < F.col("last"))
    answer = (F.col("role") == "user") & (F.col("turn") > 1)
    call = lambda x: F.struct(F.concat(F.lit(x), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")).alias("name"), F.format_string('{"a": %d, "b": [1]}', "turn").alias("arguments"))
    both = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.array(call("c"), call("d"))).otherwise(F.array(call("c")))
    turns = base.select(
        "conv_id",
        "turn",
        F.when(answer, F.when(F.col("p") == 3, "critic").otherwise("tool")).otherwise(F.col("role")).alias("role"),
        F.when((F.col("p") == 10) | asks, "").otherwise(F.col("text")).alias("content"),
        F.when(asks, both).alias("calls"),
        F.when(answer & (F.col("p") == 1), F.concat(F.lit("zz"), F.col("turn").cast("string"))).when(answer & ~F.col("p").isin(2, 3), F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"))).alias("answers"),
    )
    talks = T.conversations_of(turns).withColumn("p", F.col("conv_id") % 12)
    said = F.try_element_at("messages", T.final_position(F.col("messages")) + 1).content
    declared = F.transform(
        F.flatten("messages.calls"),
        lambda c: F.struct(
            c.id.alias("call_id"),
            F.when(F.col("p") == 6, "g").otherwise(c["name"]).alias("name"),
            F.when(F.col("p") == 7, '{"a": -1}').otherwise(F.concat(F.lit('{"b":[1],"a":'), F.get_json_object(c.arguments, "$.a"), F.lit("}"))).alias("arguments"),
        ),
    )
    none = F.array().cast("array<struct<call_id: string, name: string, arguments: string>>")
    return talks.withColumn("expected", F.when(F.col("p") == 5, none).otherwise(declared)).withColumn("expected_answer", F.when(F.col("p") == 8, "x").when(F.col("p") != 9, F.coalesce(said, F.lit("none"))))


@query(f"""
WITH RECURSIVE {_MADE},
walk AS (SELECT conv_id, 0 AS next, []::VARCHAR[] AS pending, []::VARCHAR[] AS asked, []::VARCHAR[] AS answered, []::STRUCT(position INTEGER, fault VARCHAR, id VARCHAR)[] AS faults FROM fin
  UNION ALL
  SELECT w.conv_id, w.next + 1,
    CASE WHEN m.role = 'assistant' THEN w.pending || m.calls WHEN m.role = 'tool' AND m.answers <> '' AND NOT coalesce(m.pos > f.fp, false) AND w.pending[1] = m.answers THEN w.pending[2:] ELSE w.pending END,
    CASE WHEN m.role = 'assistant' THEN w.asked || m.calls ELSE w.asked END,
    CASE WHEN m.role = 'tool' AND m.answers <> '' THEN list_append(w.answered, m.answers) ELSE w.answered END,
    CASE WHEN m.role = 'assistant' AND len(m.calls) > 0 AND m.pos > f.fp THEN list_append(w.faults, {_FAULT % ('call_after_answer', 'NULL')})
      WHEN m.role = 'tool' AND coalesce(m.answers, '') = '' THEN list_append(w.faults, {_FAULT % ('tool_without_id', 'NULL')})
      WHEN m.role = 'tool' AND m.pos > f.fp THEN list_append(w.faults, {_FAULT % ('tool_after_answer', 'm.answers')})
      WHEN m.role = 'tool' AND len(w.pending) = 0 THEN list_append(w.faults, {_FAULT % ('tool_before_call', 'm.answers')})
      WHEN m.role = 'tool' AND w.pending[1] <> m.answers THEN list_append(w.faults, {_FAULT % ('out_of_order', 'm.answers')})
      WHEN m.role NOT IN ('assistant', 'tool', 'system', 'user') THEN list_append(w.faults, {_FAULT % ('role', 'm.role')}) ELSE w.faults END
  FROM walk w JOIN msg m ON m.conv_id = w.conv_id AND m.pos = w.next JOIN fin f ON f.conv_id = w.conv_id),
done AS (SELECT walk.*, f.p, f.fp, f.said FROM walk JOIN fin f ON f.conv_id = walk.conv_id AND walk.next = f.top + 1),
call AS (SELECT conv_id, p, pos, unnest(calls) AS id FROM msg),
out AS (SELECT conv_id, x.position AS position, x.fault AS fault, x.id AS id FROM (SELECT conv_id, unnest(faults) AS x FROM done)
  UNION ALL SELECT conv_id, NULL, 'unanswered', unnest(pending) FROM done
  UNION ALL SELECT conv_id, NULL, 'never_answered', unnest(list_filter(list_distinct(asked), lambda a: NOT list_contains(answered, a))) FROM done
  UNION ALL SELECT conv_id, NULL, 'unknown_id', unnest(list_filter(list_distinct(answered), lambda a: NOT list_contains(asked, a))) FROM done
  UNION ALL SELECT conv_id, pos, CASE p WHEN 5 THEN 'undeclared' WHEN 6 THEN 'name' ELSE 'arguments' END, id FROM call WHERE p IN (5, 6, 7)
  UNION ALL SELECT conv_id, CASE WHEN p = 8 AND fp IS NOT NULL THEN fp END, CASE WHEN p = 9 THEN 'answer_missing' WHEN fp IS NULL THEN 'no_answer' ELSE 'answer_differs' END, NULL FROM done WHERE p = 9 OR fp IS NULL OR p = 8)
SELECT conv_id, CAST(position AS INTEGER) AS position, fault, id FROM out""")
def transcript_machine(spark, sf_dir):
    """Faults of conversations as transcripts with calls."""
    return T.transcript_faults(_transcripts(spark, sf_dir))


@query(f"""
WITH {_MADE},
a AS (SELECT conv_id, id, min(pos) AS asked_at FROM (SELECT conv_id, pos, unnest(calls) AS id FROM msg) GROUP BY ALL),
b AS (SELECT conv_id, answers AS id, min(pos) AS answered_at FROM msg WHERE role = 'tool' AND answers <> '' GROUP BY ALL)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.id, b.id) AS id, CAST(asked_at AS INTEGER) AS asked_at, CAST(answered_at AS INTEGER) AS answered_at FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.id = b.id""")
def call_answers_by_id(spark, sf_dir):
    """Calls and the tool messages that name them, unmatched ones of both sides included."""
    return T.call_answers(_transcripts(spark, sf_dir))
