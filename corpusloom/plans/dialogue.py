"""Queries over conversations and events: prompts, transcripts, dependencies, windows, grades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import numeric
from ..functions import text as X
from ..operators import compare, conversation, grade, windows
from . import query, table


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def last_user_turn(spark, sf_dir):
    return conversation.last_user_turn(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND text <> '' AND turn % 5 <> 1 GROUP BY conv_id")
def last_terminal_answer(spark, sf_dir):
    """Every fifth turn counts as one with calls."""
    return conversation.last_answer(table(spark, sf_dir, "conversations"), F.col("turn") % 5 == 1)


@query("SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_type END AS tool_calls, CASE WHEN event_id % 5 > 0 THEN props END AS final_answer FROM events")
def rollout_transcripts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 > 0, F.array("event_type")).alias("extracted_calls"), F.when(F.col("event_id") % 5 > 0, F.col("props")).alias("generated"))
    return grade.as_transcripts(rows).select("event_id", F.array_join("tool_calls", ",").alias("tool_calls"), "final_answer")


_JOIN = "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM ({}) WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id"


@query(_JOIN.format("SELECT c.* FROM conversations c JOIN (SELECT conv_id, max(turn) AS l FROM conversations WHERE role <> 'assistant' GROUP BY conv_id) USING (conv_id) WHERE turn <= l"))
def prompt_strip_all(spark, sf_dir):
    return conversation.render_plain(conversation.without_last_answers(table(spark, sf_dir, "conversations")))


@query(_JOIN.format("SELECT c.* FROM conversations c JOIN (SELECT conv_id, max(turn) AS l FROM conversations GROUP BY conv_id) USING (conv_id) WHERE NOT (turn = l AND role = 'assistant')"))
def prompt_strip_one(spark, sf_dir):
    return conversation.render_plain(conversation.without_last_answer(table(spark, sf_dir, "conversations")))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'assistant:' AS prompt FROM conversations GROUP BY conv_id")
def prompt_plain_all_roles(spark, sf_dir):
    return conversation.render_plain(table(spark, sf_dir, "conversations"), all_roles=True)


@query("""WITH k AS (SELECT * FROM conversations WHERE role <> 'system'), l AS (SELECT conv_id, max(turn) AS l FROM k GROUP BY conv_id)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '### User' WHEN 'assistant' THEN '### Assistant' ELSE '### Result' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '### Assistant' || chr(10) AS prompt
FROM k JOIN l USING (conv_id) WHERE NOT (turn = l AND role = 'assistant') GROUP BY conv_id""")
def prompt_render(spark, sf_dir):
    return conversation.render_prompt(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, count(*) AS n_turns, CAST(sum((turn <> coalesce(p + 1, 0))::INT) AS BIGINT) AS n_gaps, CAST(sum(coalesce(role = r AND role <> 'system', false)::INT) AS BIGINT) AS n_repeats, arg_max(role, turn) AS last_role
FROM (SELECT *, lag(turn) OVER w AS p, lag(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id""")
def turn_wellformed(spark, sf_dir):
    return conversation.turn_faults(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role, left(text, 40) AS preview FROM conversations WHERE role = 'assistant'")
def row_previews(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "role", F.left("text", F.lit(40)).alias("preview"))


_RANK = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k"


@query(f"""WITH a AS (SELECT user_id, event_id, ts, {_RANK} FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id, ts, {_RANK} FROM events WHERE event_type = 'purchase')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, a.event_id AS asked_id, b.event_id AS answer_id, coalesce(b.ts > a.ts, false) AS fits FROM a FULL JOIN b ON a.user_id = b.user_id AND a.k = b.k""")
def call_answer_fifo(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return conversation.kth_answers(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", "ts", "event_id")


_CALLS = "SELECT user_id, CAST(event_id % 500 AS VARCHAR) AS call, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN CAST((event_id * 7 + 3) % 600 AS VARCHAR) WHEN event_id % 50 = 1 THEN CAST(event_id % 500 AS VARCHAR) END AS dep FROM events"


@query(f"""WITH c AS ({_CALLS}), s AS (SELECT user_id, call, min(pos) AS p, count(*) AS n FROM c GROUP BY ALL),
f AS (SELECT c.user_id, c.call, c.dep, CASE WHEN c.dep = c.call THEN 'self' WHEN s.p IS NULL THEN 'dangling' WHEN s.p >= c.pos THEN 'not_earlier' END AS fault FROM c LEFT JOIN s ON s.user_id = c.user_id AND s.call = c.dep WHERE c.dep IS NOT NULL)
SELECT fault, count(*) AS n FROM (SELECT fault FROM f WHERE fault IS NOT NULL UNION ALL SELECT 'duplicate_id' FROM s WHERE n > 1) GROUP BY fault""")
def dependency_order(spark, sf_dir):
    calls = table(spark, sf_dir, "events").selectExpr(
        "user_id", "cast(event_id % 500 as string) as call", "event_id as pos",
        "case when event_id % 3 = 0 then array(cast((event_id * 7 + 3) % 600 as string)) when event_id % 50 = 1 then array(cast(event_id % 500 as string)) else array() end as deps",
    )
    return conversation.dependency_faults(calls, "user_id", "call", "pos", "deps").groupBy("fault").agg(F.count("*").alias("n"))


_STREAM = "(SELECT user_id, event_id AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"""WITH s AS {_STREAM} SELECT a.user_id, a.pos // 8 AS window_no, a.tok AS first_input, b.tok AS last_input, c.tok AS last_target
FROM s a JOIN s b ON b.user_id = a.user_id AND b.pos = a.pos + 7 JOIN s c ON c.user_id = a.user_id AND c.pos = a.pos + 8 WHERE a.pos % 8 = 0""")
def causal_windows(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    stream = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("tok"), (F.row_number().over(w) - 1).alias("pos"))
    out = windows.causal_windows(stream, ["user_id"], "pos", "tok", 8)
    return out.select("user_id", F.col("window").alias("window_no"), F.get("inputs", F.lit(0)).alias("first_input"), F.get("inputs", F.lit(7)).alias("last_input"), F.get("targets", F.lit(7)).alias("last_target"))


@query("WITH s AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events) SELECT event_type, pos // 16 AS row_no, list_sum(list(event_id ORDER BY pos))::BIGINT AS total, min(event_id) AS first, max(event_id) AS last FROM s WHERE pos < 64 GROUP BY ALL")
def benchmark_inputs(spark, sf_dir):
    """The first 4 rows of 16 tokens of each event type's stream."""
    w = W.partitionBy("event_type").orderBy("event_id")
    stream = table(spark, sf_dir, "events").select("event_type", "event_id", (F.row_number().over(w) - 1).alias("pos"))
    rows = windows.first_rows(stream, ["event_type"], "pos", "event_id", 16, 4)
    return rows.select("event_type", F.col("row").cast("long").alias("row_no"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.get("tokens", F.lit(0)).alias("first"), F.get("tokens", F.lit(15)).alias("last"))


@query("""WITH l AS (SELECT event_type AS m, count(*) AS n, sum(value / 100) AS total, avg(value / 100) AS mean FROM events WHERE event_type <> 'view' GROUP BY 1), m AS (SELECT event_type AS m, count(*) AS bytes FROM events GROUP BY 1)
SELECT m.m AS model_short, m.m = 'click' AS revision_verified, coalesce(n, 0) AS evaluated_tokens, round(total, 4) AS sum_loss_nats, round(mean, 6) AS mean_loss_nats, round(exp(mean), 6) AS perplexity, bytes AS source_bytes, bytes // 2 AS evaluated_bytes,
  round(total / bytes, 6) AS loss_nats_per_source_byte, round(total / greatest(1, bytes // 2), 6) AS loss_nats_per_evaluated_byte, 25 AS n_fields FROM m LEFT JOIN l ON l.m = m.m""")
def loss_records(spark, sf_dir):
    """Event types as models, values as losses; one type has none that are finite."""
    e = table(spark, sf_dir, "events")
    types = e.groupBy(F.col("event_type").alias("model_short")).agg(F.count("*").alias("n"))
    text = {c: F.lit(c).alias(c) for c in ("model_local_dir", "source_hub", "tokenizer_revision", "dtype", "device")}
    models = types.select("model_short", F.concat(F.lit("org/"), "model_short").alias("model_id"), F.when(F.col("model_short") == "click", "r1").otherwise("r2").alias("hf_revision"), F.lit("r1").alias("local_snapshot_revision"), F.lit(512).alias("seq_len"), F.lit(1.5).alias("elapsed_seconds"), F.create_map(F.lit("config.json"), F.lit("0")).alias("key_file_sha256"), *text.values())
    caches = types.select("model_short", F.lit("c").alias("cache_sha256"), F.lit("s").alias("source_sha256"), F.col("n").alias("source_bytes"), F.floor(F.col("n") / 2).alias("evaluated_bytes"), F.col("n").alias("encoded_tokens"))
    losses = e.select(F.col("event_type").alias("model_short"), F.when(F.col("event_type") == "view", float("nan")).otherwise(F.col("value") / 100).alias("loss"))
    out = compare.loss_records(models, caches, losses, "loss", "s")
    rounded = [F.round(c, d).alias(c) for c, d in (("sum_loss_nats", 4), ("mean_loss_nats", 6), ("perplexity", 6), ("loss_nats_per_source_byte", 6), ("loss_nats_per_evaluated_byte", 6))]
    return out.select("model_short", "revision_verified", "evaluated_tokens", "source_bytes", "evaluated_bytes", *rounded, F.lit(len(out.columns)).alias("n_fields"))


@query("SELECT user_id, count(*) AS n, CAST(count(*) - ceil((count(*) - 1) / 16) AS BIGINT) AS scored FROM events GROUP BY user_id")
def scoring_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("scored", windows.scored_tokens(F.col("n"), 16).cast("long"))


@query("SELECT count(*) AS n_tokens, round(avg(value), 6) AS mean_loss, round(exp(avg(value / 100)), 6) AS perplexity, round(sum(value) / 1e6, 6) AS nats_per_byte, event_type FROM events GROUP BY event_type")
def loss_totals(spark, sf_dir):
    sums = compare.loss_totals(table(spark, sf_dir, "events").withColumn("loss", F.col("value")), ["event_type"], "loss", F.lit(1_000_000))
    return sums.select("event_type", "n_tokens", F.round("mean_loss", 6).alias("mean_loss"), F.round(F.exp(F.col("mean_loss") / 100), 6).alias("perplexity"), F.round("nats_per_byte", 6).alias("nats_per_byte"))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) <= greatest(1, ceil(1.0 * (SELECT count(*) FROM embeddings) / 10)) AS kept FROM embeddings")
def capacity_routing(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    cap = vectors.agg(numeric.capacity(F.count("*"), 10, 1.0).alias("_c"))
    return windows.route(vectors.crossJoin(F.broadcast(cap)), "label", "vec_id", F.col("_c")).drop("_c")  # one row


@query("SELECT label, count(*) AS assigned, greatest(0, count(*) - 48) AS dropped FROM embeddings GROUP BY label")
def routing_drops(spark, sf_dir):
    kept = windows.route(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", F.lit(48))
    return kept.groupBy("label").agg(F.count("*").alias("assigned"), F.count_if(~F.col("kept")).alias("dropped"))


@query("""WITH e AS (SELECT vec_id % 4 AS layer, label, count(*) AS c FROM embeddings GROUP BY ALL), t AS (SELECT label, sum(c) AS c FROM e GROUP BY label), d AS (SELECT sum(greatest(0, c - 12)) AS dropped FROM e)
SELECT CAST(sum(c) AS BIGINT) AS assigned, round(max(c) / avg(c), 6) AS imbalance, CAST(any_value(dropped) AS BIGINT) AS dropped FROM t, d""")
def routing_aggregate(spark, sf_dir):
    """Four layers' counts by expert, given as arrays."""
    counts = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 4).alias("layer"), "label").agg(F.count("*").alias("c"))
    layers = counts.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("x"))
    layers = layers.select("layer", F.transform("x", lambda x: x["c"]).alias("assigned"), F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(0).cast("long"), x["c"] - 12)).alias("dropped"))
    return compare.routing_totals(layers, [], "assigned", "dropped", 125).select("assigned", F.round("imbalance", 6).alias("imbalance"), "dropped")


@query("SELECT round(10 * sum(p * n / t), 6) AS load_balance FROM (SELECT avg(embedding[1]) AS p, count(*) AS n FROM embeddings GROUP BY label), (SELECT count(*) AS t FROM embeddings)")
def load_balance_stat(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("p"))
    return windows.load_balance(vectors, "label", "p", 10).select(F.round("load_balance", 6).alias("load_balance"))


@query("SELECT event_id, user_id, round(CASE WHEN s < 1e-6 THEN 0 ELSE (value - m) / s END, 6) + 0.0 AS advantage FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id) USING (user_id)")
def group_advantage(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return windows.group_advantage(events, "user_id", "value").select("event_id", "user_id", (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY user_id")
def advantage_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))


_SEEDS = "SELECT user_id % 5 AS seed, event_type, count(*) AS n FROM events GROUP BY ALL"


@query(f"""WITH n AS ({_SEEDS}), r AS (SELECT event_type, seed, n / sum(n) OVER (PARTITION BY seed) AS rate FROM n)
SELECT event_type, count(*) AS n_seeds, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS std, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds FROM r GROUP BY event_type""")
def seed_aggregate(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("seed"), "event_type").agg(F.count("*").alias("n"))
    rates = n.join(n.groupBy("seed").agg(F.sum("n").alias("t")), "seed").withColumn("rate", F.col("n") / F.col("t"))
    return compare.seed_summary(rates, "event_type", "seed", "rate").select("event_type", "n_seeds", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "seeds")


_LAYER = {x: f"CASE WHEN event_id % {p} = {r} THEN NULL ELSE (event_id * {m}) % 17 > {c} END" for x, p, r, m, c in zip(grade.LAYERS, (997, 11, 13, 17, 19, 7, 5, 23), (1, 2, 3, 4, 5, 6, 4, 8), (3, 5, 7, 11, 13, 2, 6, 9), (0, 1, 2, 2, 3, 3, 2, 4), strict=True)}
_GRADES = "SELECT event_id, event_type, " + ", ".join(f"{v} AS {k}" for k, v in _LAYER.items()) + " FROM events"
_FIRST = "coalesce(" + ", ".join(f"CASE WHEN NOT {x} THEN '{x}' END" for x in grade.LAYERS) + ")"
_APPLIED = "(" + " + ".join(f"({x} IS NOT NULL)::INT" for x in grade.LAYERS) + ")"
_TRUE = "(" + " + ".join(f"coalesce({x}, false)::INT" for x in grade.LAYERS) + ")"
_GRADED = f"SELECT *, {_FIRST} AS first_failure, CASE WHEN {_APPLIED} > 0 AND {_FIRST} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward_binary, coalesce({_TRUE}::DOUBLE / nullif({_APPLIED}, 0), 0.0) AS reward_layered FROM ({_GRADES})"


def _grades(spark, sf_dir):
    """Eight three-valued layers, made from event ids."""
    return grade.graded(table(spark, sf_dir, "events").selectExpr("event_id", "event_type", *[f"{v} AS {k}" for k, v in _LAYER.items()]))


@query(f"SELECT event_id, first_failure, reward_binary, round(reward_layered, 6) AS reward_layered FROM ({_GRADED})")
def grade_layers_flat(spark, sf_dir):
    return _grades(spark, sf_dir).select("event_id", "first_failure", "reward_binary", F.round("reward_layered", 6).alias("reward_layered"))


@query(f"SELECT event_type, coalesce(first_failure, 'none') AS first_failure, count(*) AS n FROM ({_GRADED}) GROUP BY ALL")
def first_failure_hist(spark, sf_dir):
    return grade.failure_histogram(_grades(spark, sf_dir), "event_type")


@query(f"SELECT event_type, count(*) AS n, round(avg(reward_binary), 6) AS binary_mean, round(stddev_pop(reward_binary), 6) AS binary_std, round(avg(reward_layered), 6) AS layered_mean, round(stddev_pop(reward_layered), 6) AS layered_std FROM ({_GRADED}) GROUP BY event_type")
def reward_aggregate(spark, sf_dir):
    sums = grade.reward_summary(_grades(spark, sf_dir), "event_type")
    return sums.select("event_type", "n", *[F.round(c, 6).alias(c) for c in sums.columns if c not in ("event_type", "n")])


@query(f"SELECT event_type, round(avg(coalesce(parse_success, false)::INT), 6) AS parse_rate FROM ({_GRADES}) GROUP BY event_type")
def parse_success_rate(spark, sf_dir):
    return grade.parse_rate(_grades(spark, sf_dir), "event_type").select("event_type", F.round("parse_rate", 6).alias("parse_rate"))


@query(f"SELECT event_id, CASE WHEN parse_success IS DISTINCT FROM true THEN 'parse_success' WHEN first_failure = 'final_answer_correct' THEN 'final_answer_correct' WHEN first_failure IS NULL THEN 'execution_correct' ELSE 'argument_correct' END AS channel FROM ({_GRADED})")
def dominant_reward(spark, sf_dir):
    return _grades(spark, sf_dir).select("event_id", grade.dominant_reward(F.col("parse_success"), F.col("first_failure")).alias("channel"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_transcripts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.struct("ts", "event_id").alias("pos"))
    return grade.latest(rows, "key", "pos").select(F.col("key").cast("long").alias("user_id"), "event_id")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{}' ELSE props END AS arguments, TRY_CAST(json_extract_string(CASE WHEN event_id % 9 = 0 THEN '{}' ELSE props END, '$.k') AS BIGINT) AS k FROM events")
def json_args_normalize(spark, sf_dir):
    """Arguments as an object; what is none of it (made from every ninth row) becomes {}."""
    raw = F.when(F.col("event_id") % 18 == 0, "[1]").when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", X.arguments(raw).alias("a"))
    return rows.select("event_id", F.replace("a", F.lit('":'), F.lit('": ')).alias("arguments"), F.get_json_object("a", "$.k").cast("long").alias("k"))


@query("SELECT event_id, contains(coalesce(CASE WHEN event_id % 4 > 0 THEN props END, ''), CASE WHEN event_id % 5 > 0 THEN left(event_type, CAST(event_id % 3 AS INT)) END) AS ok FROM events")
def answer_contained(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.contained(F.when(F.col("event_id") % 4 > 0, F.col("props")), F.when(F.col("event_id") % 5 > 0, F.left("event_type", (F.col("event_id") % 3).cast("int")))).alias("ok"))


@query("SELECT event_id, strftime(make_timestamp((1785000042 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events")
def deterministic_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numeric.timestamp_text(42, F.col("event_id")).alias("created_at"))


@query("SELECT event_id, event_id % 4 AS a, event_id // 4 % 7 AS b, event_id // 28 % 3 AS c FROM events")
def variant_radix(spark, sf_dir):
    a, b, c = numeric.radix(F.col("event_id"), [4, 7, 3])
    return table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"), c.alias("c"))


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.003 * (event_id + 1) / 100.0 ELSE 0.0003 + 0.5 * (0.003 - 0.0003) * (1 + cos(pi() * least(1.0, (event_id - 100) / 4900.0))) END, 9) AS rate FROM events")
def cosine_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(numeric.cosine_rate(F.col("event_id"), 0.003, 0.0003, 100, 5000), 9).alias("rate"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 250 = 0 OR event_id = 777")
def logged_steps(spark, sf_dir):
    return compare.logged_steps(table(spark, sf_dir, "events"), "event_id", 250, 777).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id >= 40 ORDER BY event_id LIMIT 25")
def cursor_resume(spark, sf_dir):
    """The next 25 rows from a cursor on."""
    return table(spark, sf_dir, "events").where("event_id >= 40").orderBy("event_id").limit(25).select("event_id", "user_id")


@query("SELECT event_id, regexp_matches(lower(event_type), 'click|pur.*se') AS hit FROM events")
def pattern_predicate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.matches_any(F.col("event_type"), ["click", "pur.*se"]).alias("hit"))
