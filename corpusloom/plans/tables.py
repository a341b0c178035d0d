"""Queries over orders, line items, pages and dimension tables: comparisons, sets, rules, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as X
from ..operators import audit, compare, contracts, reconcile, rules
from . import query, table


@query("SELECT DISTINCT o_orderpriority AS priority, round(f, 6) AS base, round(p, 6) AS other, round((p - f) / abs(nullif(f, 0)) * 100, 6) AS delta_pct, coalesce(printf('%.2f', (p - f) / abs(nullif(f, 0)) * 100), '') AS shown FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS p FROM orders GROUP BY 1)")
def backend_delta(spark, sf_dir):
    """Two order statuses as two backends."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    out = compare.backend_delta(runs, ["priority"], "o_orderstatus", "m", "F", "O").withColumn("shown", compare.delta_text(F.col("delta_pct")))
    return out.select("priority", *[F.round(c, 6).alias(c) for c in ("base", "other", "delta_pct")], "shown")


_DAYS = "SELECT o_orderpriority AS curve, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS step, avg(o_totalprice) AS loss FROM orders GROUP BY ALL"


@query(f"SELECT curve, round(arg_min(loss, step), 4) AS first, round(arg_max(loss, step), 4) AS last, round(min(loss), 4) AS least, arg_min(step, loss) AS least_step, round(arg_max(loss, step) - arg_min(loss, step), 4) AS change, round(arg_max(loss, step) - min(loss), 4) AS above_least, count(*) AS n FROM ({_DAYS}) GROUP BY curve")
def curve_summary(spark, sf_dir):
    """Mean order prices by day as a loss curve of each priority."""
    step = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("step")
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("curve"), step).agg(F.avg("o_totalprice").alias("loss"))
    out = compare.curve_summary(points, ["curve"], "step", "loss", "step")
    return out.select("curve", *[F.round(c, 4).alias(c) for c in ("first", "last", "least", "change", "above_least")], "least_step", "n")


@query("SELECT o_custkey % 10 AS curve, CAST(o_orderkey AS BIGINT) AS step, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 11 <> 3")
def curve_points(spark, sf_dir):
    """Maps with numbers as text keys; keys that are no numbers (made from some rows) are left out."""
    key = F.when(F.col("o_orderkey") % 11 == 3, F.concat(F.lit("step-"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    maps = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("curve"), F.create_map(key, F.round("o_totalprice", 2)).alias("m"))
    return compare.curve_points(maps, "curve", "m")


@query("SELECT l_returnflag AS flag, count(s) AS n, round(coalesce(sum(s) * 1000 / nullif(count(s), 0), 0), 6) AS ms_per_item, round(coalesce(count(s) / nullif(sum(s), 0), 0), 6) AS items_per_s FROM (SELECT l_returnflag, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS s FROM lineitem) GROUP BY 1")
def timing_summary(spark, sf_dir):
    """Quantities as seconds; one group has none."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("s"))
    return compare.timing(rows, ["flag"], "s").select("flag", "n", F.round("ms_per_item", 6).alias("ms_per_item"), F.round("items_per_s", 6).alias("items_per_s"))


@query("SELECT p_partkey, arg_min(width, (abs(p_size - size), width)) AS width FROM part, (SELECT unnest([8, 16, 24, 32, 48]) AS size, unnest(['a', 'b', 'c', 'd', 'e']) AS width) GROUP BY p_partkey")
def nearest_width(spark, sf_dir):
    widths = list(zip("abcde", [8, 16, 24, 32, 48], strict=True))
    return compare.nearest(table(spark, sf_dir, "part"), ["p_partkey"], "width", widths, F.col("p_size"))


@query("SELECT p_partkey, round(abs(p_retailprice - 1000.0) / greatest(1, 1000.0), 6) AS error FROM part")
def relative_error(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numeric.relative_error(F.col("p_retailprice"), F.lit(1000.0)), 6).alias("error"))


@query("SELECT l_orderkey, list_sort(list(l_suppkey % 5)) = list_sort(list(l_partkey % 5)) AS equal FROM lineitem GROUP BY l_orderkey")
def multiset_equal(spark, sf_dir):
    """Are two lists of an order equal as multisets? An order has a bounded number of lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_suppkey") % 5)).alias("a"), F.array_sort(F.collect_list(F.col("l_partkey") % 5)).alias("b"))
    return rows.select("l_orderkey", (F.col("a") == F.col("b")).alias("equal"))


@query("SELECT l_orderkey, CAST(count(DISTINCT a) AS BIGINT) AS n_missing FROM (SELECT l_orderkey, l_suppkey % 7 AS a FROM lineitem) x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_partkey % 7 = x.a) GROUP BY l_orderkey")
def subset_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 7).alias("a"), F.collect_set(F.col("l_partkey") % 7).alias("b"))
    return rows.select("l_orderkey", F.size(F.array_except("a", "b")).cast("long").alias("n_missing")).where("n_missing > 0")


@query("SELECT coalesce(a.l_orderkey, b.o_orderkey) AS order_key, a.n AS n_lines, b.t AS total FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 10 < 7 GROUP BY 1) a FULL JOIN (SELECT o_orderkey, round(o_totalprice, 2) AS t FROM orders WHERE o_orderkey % 10 > 4) b ON a.l_orderkey = b.o_orderkey WHERE (a.n > 5) IS DISTINCT FROM (b.t > 200000)")
def run_differences(spark, sf_dir):
    """Two runs' states by key, full outer, where they differ."""
    a = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 < 7").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("n_lines"))
    b = table(spark, sf_dir, "orders").where("o_orderkey % 10 > 4").select(F.col("o_orderkey").alias("order_key"), F.round("o_totalprice", 2).alias("total"))
    return a.join(b, "order_key", "full_outer").where("not ((n_lines > 5) <=> (total > 200000))")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS want, b.l_partkey AS got FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1 WHERE a.l_partkey % 3 = b.l_partkey % 3")
def positional_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = rows.withColumnRenamed("l_partkey", "want"), rows.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("got"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("want % 3 = got % 3")


@query("SELECT r_name AS model, n_name AS revision, b AS batch FROM region, (SELECT * FROM nation WHERE n_nationkey < 4), (SELECT unnest([1, 4]) AS b)")
def cross_join_plan(spark, sf_dir):
    """Every model with every revision and batch size: plans, not data, so small."""
    a = table(spark, sf_dir, "region").select(F.col("r_name").alias("model"))
    b = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.col("n_name").alias("revision"))
    return a.crossJoin(b).withColumn("batch", F.explode(F.array(F.lit(1), F.lit(4))))


@query("SELECT n_nationkey, replace(replace(n_name || '/a b', '/', '__'), ' ', '_') AS slug, sha256(replace('x' || chr(10) || n_name || chr(13) || chr(10), chr(13) || chr(10), chr(10)).replace(chr(10), chr(13) || chr(10))) AS digest FROM nation")
def slugs(spark, sf_dir):
    text = F.concat(F.lit("x\n"), "n_name", F.lit("\r\n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.slug(F.concat("n_name", F.lit("/a b"))).alias("slug"), X.crlf_insensitive_digest(text).alias("digest"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value IS NULL THEN 'value: required' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type: enum' END,
  CASE WHEN NOT regexp_matches(props, '^\\{"k": [0-9]{2}\\}$') THEN 'props: pattern' END, CASE WHEN value < 2 THEN 'value: minimum' END, CASE WHEN user_id > 100 THEN 'user_id: maximum' END], lambda x: x IS NOT NULL), ';') AS errors
FROM (SELECT * REPLACE (CASE WHEN event_id % 31 > 0 THEN value END AS value) FROM events)""".replace("\\\\", "\\"))
def schema_rule_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 31 > 0, F.col("value")))
    checks = [rules.required("value"), rules.one_of("event_type", ["click", "view", "purchase"]), rules.pattern("props", r'^\{"k": [0-9]{2}\}$'), rules.at_least("value", 2), rules.at_most("user_id", 100)]
    return rules.rule_errors(rows, checks).select("event_id", F.array_join("errors", ";").alias("errors"))


_REFS = r"SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=[\"'']([^\"''#\s>]+)', 1)) AS ref FROM pages"
_KIND = r"CASE WHEN regexp_matches(ref, '^[a-z]+:') THEN 'external' WHEN contains(ref, '*') THEN 'glob' WHEN contains(ref, '{') THEN 'braces' WHEN ref LIKE '%/' THEN 'directory' WHEN regexp_matches(ref, '\.[A-Za-z0-9]{1,5}$') THEN 'file' ELSE 'bare' END"


@query(_REFS)
def url_refs(spark, sf_dir):
    return audit.references(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"SELECT {_KIND} AS kind, count(*) AS n FROM ({_REFS}) GROUP BY 1")
def ref_kind_counts(spark, sf_dir):
    return audit.references(table(spark, sf_dir, "pages"), "page_id", "html").groupBy(audit.kind(F.col("ref")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN ref IN (SELECT url FROM pages) THEN 'exact' WHEN ref || '/' IN (SELECT url FROM pages) OR ref || '.html' IN (SELECT url FROM pages) THEN 'extension' ELSE 'missing' END AS status FROM ({_REFS})) GROUP BY status")
def ref_status_counts(spark, sf_dir):
    refs = audit.references(table(spark, sf_dir, "pages"), "page_id", "html")
    return audit.resolved(refs, table(spark, sf_dir, "pages").select(F.col("url").alias("path")), ["/", ".html"]).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, printf('%.1f', o_orderkey / 3) AS shown, o_orderkey % 2 = 0 AS ok FROM orders")
def drift_check(spark, sf_dir):
    """A value, shown with one digit, against a text that has it for every second row."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") / 3).alias("v"))
    text = F.concat(F.lit("loss "), F.when(F.col("o_orderkey") % 2 == 0, F.format_string("%.1f", "v")).otherwise(F.format_string("%.1f", F.col("v") + 1)), F.lit(" @ 5 | 0.0 |"))
    return audit.drift(rows.withColumn("text", text), F.col("v"), F.col("text"), 1).select("o_orderkey", "shown", "ok")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS percent FROM customer GROUP BY 1")
def category_coverage(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("segment", "n", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 6).alias("percent"))  # one row


@query("SELECT l_orderkey, count(*) AS n_batches, round(avg(l_quantity), 6) AS mean_loss FROM lineitem WHERE l_linenumber - 1 < 3 GROUP BY 1")
def first_batches_mean(spark, sf_dir):
    """Lines of an order as batches: the mean of the first three."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("batch"), "l_quantity")
    return compare.first_batches(rows, ["l_orderkey"], "batch", "l_quantity", 3).withColumn("mean_loss", F.round("mean_loss", 6))


@query("SELECT segment, status, n, round(n / sum(t) OVER (PARTITION BY segment), 9) AS share FROM (SELECT 's' || o_custkey % 4 AS segment, o_orderstatus AS status, count(*) FILTER (o_orderkey % 3 > 0) AS n, count(*) AS t FROM orders GROUP BY ALL) QUALIFY n > 0")
def histogram_over_files(spark, sf_dir):
    """Statuses of orders as failures, priorities as files, all orders as totals."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 4).alias("segment"), "o_orderpriority", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3 > 0).alias("failed"))
    counts = rows.where("failed").groupBy("segment", "o_orderpriority", "status").agg(F.count("*").alias("n"))
    totals = rows.groupBy("segment", "o_orderpriority").agg(F.count("*").alias("total"))
    return compare.histogram_shares(counts, totals, ["segment"], "status", "n", "total").withColumn("share", F.round("share", 9))


@query("SELECT p_partkey, p_brand FROM part WHERE contains(p_brand, '1') OR contains(p_brand, '#4')")
def name_filter(spark, sf_dir):
    return compare.named_like(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", ["1", "#4"])


@query("SELECT n_nationkey, pos FROM nation JOIN (SELECT unnest(['n-3', 'n-11', 'n-7']) AS a, CAST(unnest([0, 1, 2]) AS BIGINT) AS pos) ON a = 'n-' || n_nationkey")
def resolved_names(spark, sf_dir):
    """Two nations by a short name and one by its full name."""
    models = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n-"), "n_nationkey").alias("short"), F.col("n_name").alias("full"))
    full = models.where("n_nationkey = 11").first()["full"]
    return compare.resolved_names(models, "short", "full", ["n-3", full, "n-7"]).select("n_nationkey", "pos")


@query("SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'outcome' ELSE 'result' END AS fault FROM events WHERE event_type = 'purchase' OR (user_id % 4 > 0 AND event_id % 3 <> user_id % 3)")
def result_differences(spark, sf_dir):
    """Events as calls of a user, by their unique place: purchases failed; every fourth user's have no expected result."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 3).alias("expected_result"), F.when(F.col("event_type") == "purchase", "error").otherwise("success").alias("outcome"), (F.col("event_id") % 3).alias("result"))
    return contracts.result_differences(rows, rows, "user_id", "event_id")


@query("""SELECT o_orderkey AS artifact, o_orderkey AS doc, CAST(1 AS BIGINT) AS line_no, 'step' AS fault FROM orders WHERE o_orderkey % 5 <> 2
UNION ALL SELECT o_orderkey, o_orderkey, 2, 'change' FROM orders WHERE o_orderkey % 3 > 0""")
def line_drifts(spark, sf_dir):
    """Texts with a step after the value, a row of cells, a line with the value twice, and one with another value's step."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") / 8).alias("value"), (F.col("o_orderkey") % 5).cast("long").alias("step"), (F.col("o_orderkey") % 3).cast("double").alias("change"))
    shown = F.format_string("%.4f", "value")
    text = F.concat(F.lit("least "), shown, F.lit(" @ 2 steps\r\n| "), shown, F.lit(" | 0.0 |\n"), shown, F.lit(" and "), shown, F.lit(" @ 9\nother xx @ 7 | 0.0 |"))
    return audit.line_drifts(rows, rows.select("doc", text.alias("text")))


@query("SELECT p_partkey, 'part-' || p_brand AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS tail FROM part")
def id_parts(spark, sf_dir):
    name = F.concat(F.lit("part-"), "p_brand", F.lit("-"), F.format_string("%04d", F.col("p_size").cast("int")))
    head, tail = X.id_parts(name)
    return table(spark, sf_dir, "part").select("p_partkey", head.alias("head"), tail.alias("tail"))


# A page's address as a path, and a text that refers to it and others in a way that depends on page_id.
_TREE = r"""
page AS (SELECT page_id, regexp_extract(url, '//([a-z0-9.]+)/([a-z]+)/([0-9]+)', 1) AS host, regexp_extract(url, '//([a-z0-9.]+)/([a-z]+)/([0-9]+)', 2) AS lang, regexp_extract(url, '//([a-z0-9.]+)/([a-z]+)/([0-9]+)', 3) AS num FROM pages WHERE regexp_matches(url, '//([a-z0-9.]+)/([a-z]+)/([0-9]+)')),
files AS (SELECT DISTINCT 'artifacts/' || host || '/' || lang || '/' || num || CASE page_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.png' ELSE '' END AS path FROM page UNION SELECT DISTINCT 'scripts/build_' || (page_id % 4) || '.py' FROM page),
dirs AS (SELECT DISTINCT 'artifacts' AS path FROM page UNION SELECT 'artifacts/' || host FROM page UNION SELECT 'artifacts/' || host || '/' || lang FROM page UNION SELECT 'scripts' FROM page),
said AS (SELECT page_id, 'artifacts/' || host || '/' || lang || '/' || num || '.json' AS ref, 'exact_file' AS kind, ['artifacts/' || host || '/' || lang || '/' || num || '.json'] AS c FROM page WHERE page_id % 8 = 0
  UNION ALL SELECT page_id, 'artifacts/' || host || '/' || lang || '/' || num, 'exact_file', ['artifacts/' || host || '/' || lang || '/' || num] FROM page WHERE page_id % 8 = 1
  UNION ALL SELECT page_id, 'artifacts/' || host || '/' || lang || '/', 'directory', ['artifacts/' || host || '/' || lang] FROM page WHERE page_id % 8 = 2
  UNION ALL SELECT page_id, 'artifacts/' || host || '/' || lang || '/*.json', 'glob_pattern', ['artifacts/' || host || '/' || lang || '/*.json'] FROM page WHERE page_id % 8 = 3
  UNION ALL SELECT page_id, 'artifacts/' || host || '/{en,fr}/*', 'glob_pattern', ['artifacts/' || host || '/en/*', 'artifacts/' || host || '/fr/*'] FROM page WHERE page_id % 8 = 4
  UNION ALL SELECT page_id, unnest(['artifacts/run-', 'artifacts/<name>.json']), 'placeholder', [] FROM page WHERE page_id % 8 = 5
  UNION ALL SELECT page_id, 'artifacts/none/x' || page_id || '.json', 'exact_file', ['artifacts/none/x' || page_id || '.json'] FROM page WHERE page_id % 8 = 6
  UNION ALL SELECT page_id, 'artifacts/*/' || lang || '/{' || num || ',zz}*', 'glob_pattern', ['artifacts/*/' || lang || '/' || num || '*', 'artifacts/*/' || lang || '/zz*'] FROM page WHERE page_id % 8 = 7
  UNION ALL SELECT page_id, 'artifacts/{a,b{c,d}}/m-*/', 'directory', ['artifacts/a/m-*', 'artifacts/bc/m-*', 'artifacts/bd/m-*'] FROM page WHERE page_id % 10 = 0),
hit AS (SELECT DISTINCT page_id, ref, p.path FROM (SELECT page_id, ref, kind, unnest(c) AS c FROM said) s JOIN (SELECT path, false AS d FROM files UNION ALL SELECT path, true FROM dirs) p ON p.d = (s.kind = 'directory')
  AND regexp_full_match(p.path, replace(replace(s.c, '.', '\.'), '*', '[^/]*'))),
more AS (SELECT page_id, ref, ref || x AS path FROM said, (SELECT unnest(['.json', '.png']) AS x) WHERE kind = 'exact_file' AND ref || x IN (SELECT path FROM files)),
out AS (SELECT s.page_id, s.ref, s.kind, CASE WHEN s.page_id % 8 = 6 AND s.kind = 'exact_file' THEN 'scripts/build_' || (s.page_id % 5) || '.py' END AS script,
  CASE WHEN n IS NOT NULL THEN n WHEN m.first IS NOT NULL THEN 1 ELSE 0 END AS n_matches, coalesce(h.least, m.first) AS match FROM said s
  LEFT JOIN (SELECT page_id, ref, count(*) AS n, min(path) AS least FROM hit GROUP BY ALL) h ON h.page_id = s.page_id AND h.ref = s.ref
  LEFT JOIN (SELECT page_id, ref, min(path) AS first FROM more GROUP BY ALL) m ON m.page_id = s.page_id AND m.ref = s.ref),
done AS (SELECT *, CASE WHEN kind = 'placeholder' THEN 'PLACEHOLDER' WHEN n_matches > 0 THEN 'FOUND' WHEN script IN (SELECT path FROM files) THEN 'MISSING_RESOLVABLE' ELSE 'MISSING_UNRESOLVABLE' END AS status FROM out)"""


def _reconciled(spark, sf_dir):
    part = lambda i: F.regexp_extract("url", r"//([a-z0-9.]+)/([a-z]+)/([0-9]+)", i)
    pages = table(spark, sf_dir, "pages").select("page_id", part(1).alias("host"), part(2).alias("lang"), part(3).alias("num")).where("host <> ''")
    folder = F.concat(F.lit("artifacts/"), "host", F.lit("/"), "lang", F.lit("/"))
    number = F.col("page_id") % 8
    files = pages.select(F.concat(folder, "num", F.when(F.col("page_id") % 3 == 0, ".json").when(F.col("page_id") % 3 == 1, ".png").otherwise("")).alias("path"))
    files = files.union(pages.select(F.concat(F.lit("scripts/build_"), (F.col("page_id") % 4).cast("string"), F.lit(".py"))))
    gone = F.concat(F.lit("artifacts/none/x"), F.col("page_id").cast("string"), F.lit(".json"))
    text = (
        F.when(number == 0, F.concat(F.lit("see "), folder, "num", F.lit(".json\n")))
        .when(number == 1, F.concat(F.lit("see "), folder, "num", F.lit(" and more")))
        .when(number == 2, F.concat(F.lit("in "), folder, F.lit(" twice "), folder, F.lit(" ")))
        .when(number == 3, F.concat(folder, F.lit("*.json\n")))
        .when(number == 4, F.concat(F.lit("`artifacts/"), "host", F.lit("/{en,fr}/*`")))
        .when(number == 5, F.lit("artifacts/run- (one of artifacts/<name>.json)"))
        .when(number == 6, F.concat(F.lit("missing\npython scripts/build_"), (F.col("page_id") % 5).cast("string"), F.lit(".py --out \\\n  "), gone, F.lit("\n")))
        .otherwise(F.concat(F.lit("artifacts/*/"), "lang", F.lit("/{"), "num", F.lit(",zz}*")))
    )
    docs = pages.select("page_id", F.concat(text, F.when(F.col("page_id") % 10 == 0, "\nartifacts/{a,b{c,d}}/m-*/").otherwise("")).alias("text"))
    return reconcile.reconciled(reconcile.references(docs, "page_id"), files)


@query(f"WITH {_TREE} SELECT DISTINCT page_id, ref, kind, script, n_matches, match, status FROM done")
def reconcile_pages(spark, sf_dir):
    """References of pages against a tree made of all pages' addresses."""
    return _reconciled(spark, sf_dir).select("page_id", "ref", "kind", "script", "n_matches", "match", "status")


@query(f"WITH {_TREE} SELECT kind, count(*) AS total, count(*) FILTER (status = 'PLACEHOLDER') AS placeholder, count(*) FILTER (status = 'FOUND') AS found, count(*) FILTER (status = 'MISSING_RESOLVABLE') AS missing_resolvable, count(*) FILTER (status = 'MISSING_UNRESOLVABLE') AS missing_unresolvable FROM done GROUP BY kind")
def reconcile_pivot(spark, sf_dir):
    """Kinds by status."""
    return reconcile.status_pivot(_reconciled(spark, sf_dir))
