"""Queries over documents, labels and the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, ranks, splits
from . import query, table

# RE2 has no look-ahead: the place inside white space where a word takes its space is marked first.
_W = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
_TOKS = rf"""regexp_extract_all(regexp_replace(text, '([{_W}]+)([{_W}])([^{_W}])', '\1' || chr(1) || '\2\3', 'g'),
  '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}\x{{01}}]+|[{_W}]+')"""
_WORDS = f"words AS (SELECT tok, count(*) AS n FROM (SELECT unnest({_TOKS}) AS tok FROM documents) GROUP BY tok)"
_SEED = "sha256('42:' || CAST({} AS VARCHAR))"


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT doc_id, text, {_TOKS} AS t FROM documents)")
def pretoken_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.pretokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.char_length("text").cast("long").alias("n_chars"))


@query(f"SELECT lang, count(*) AS n_docs, CAST(sum(len({_TOKS})) AS BIGINT) AS n_tokens FROM documents GROUP BY lang")
def pretoken_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.size(text.pretokens(F.col("text"))).cast("long").alias("n"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


@query(f"WITH {_WORDS} SELECT tok, n FROM words ORDER BY n DESC, tok LIMIT 100")
def pretoken_top_words(spark, sf_dir):
    return corpus.word_table(table(spark, sf_dir, "documents")).orderBy(F.desc("n"), "tok").limit(100)


_PAIRS = f"""WITH {_WORDS},
p AS (SELECT DISTINCT tok, n, substr(hex(tok), 2 * i - 1, 2) AS l, substr(hex(tok), 2 * i + 1, 2) AS r FROM (SELECT tok, n, unnest(range(1, strlen(tok))) AS i FROM words WHERE strlen(tok) > 1))
SELECT l AS left_byte, r AS right_byte, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY l, r"""


@query(_PAIRS)
def byte_pair_counts_round0(spark, sf_dir):
    return corpus.pair_counts(corpus.word_table(table(spark, sf_dir, "documents")))


@query(_PAIRS + " ORDER BY n DESC, l DESC, r DESC LIMIT 1")
def best_pair(spark, sf_dir):
    pairs = corpus.pair_counts(corpus.word_table(table(spark, sf_dir, "documents")))
    return pairs.orderBy(F.desc("n"), F.desc("left_byte"), F.desc("right_byte")).limit(1)


@query("SELECT doc_id, n_bytes, CAST(cum AS BIGINT) AS cum_bytes FROM (SELECT doc_id, strlen(text) AS n_bytes, sum(strlen(text)) OVER (ORDER BY doc_id) AS cum FROM documents) WHERE cum <= 1000000")
def byte_budget_prefix(spark, sf_dir):
    return corpus.byte_prefix(table(spark, sf_dir, "documents").select("doc_id", "text"), 1_000_000).select("doc_id", "n_bytes", "cum_bytes")


@query("SELECT count(*) AS n_docs, CAST(coalesce(max(cum), 0) AS BIGINT) AS n_bytes FROM (SELECT sum(strlen(text)) OVER (ORDER BY doc_id) AS cum FROM documents) WHERE cum <= 500000")
def training_prefix_bytes(spark, sf_dir):
    return corpus.prefix_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 500_000)


@query(r"SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, strlen(l[i]) AS n_bytes FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, unnest(range(1, len(l) + 1)) AS i FROM documents)")
def line_table(spark, sf_dir):
    return corpus.line_table(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "n_bytes")


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def canonical_duplicates(spark, sf_dir):
    return corpus.duplicates(table(spark, sf_dir, "documents"))


@query("SELECT lang, count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct FROM documents GROUP BY lang")
def signature_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_distinct"))


_HASH_SPLIT = f"CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT *, ('0x' || left({_SEED.format('doc_id')}, 8))::BIGINT % 100 AS b FROM documents)"


@query(f"SELECT split, count(*) AS n FROM (SELECT doc_id, {_HASH_SPLIT}) GROUP BY split")
def hash_split_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(splits.hash_split(42, F.col("doc_id")).alias("split"))
    return docs.groupBy("split").agg(F.count("*").alias("n"))


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_SEED.format('doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) * 15 // 100 + CASE WHEN count(*) OVER (PARTITION BY lang) * 15 % 100 > 50 OR (count(*) OVER (PARTITION BY lang) * 15 % 100 = 50 AND count(*) OVER (PARTITION BY lang) * 15 // 100 % 2 = 1) THEN 1 ELSE 0 END AS s FROM documents)"
_STRATIFIED = f"SELECT doc_id, lang, text, CASE WHEN r <= s THEN 'test' WHEN r <= 2 * s THEN 'dev' ELSE 'train' END AS split FROM {_RANKED}"


@query(f"SELECT doc_id, lang, split FROM ({_STRATIFIED})")
def stratified_split_by_lang(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 42)


@query(f"SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY lang, {_SEED.format('doc_id')}, doc_id) AS pos FROM ({_STRATIFIED})")
def split_positions(spark, sf_dir):
    return splits.split_positions(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 42).select("doc_id", "split", "pos")


@query(f"SELECT doc_id, lang, v AS variant, v % 4 AS part_0, v // 4 % 7 AS part_1, v // 28 % 3 AS part_2 FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEED.format('doc_id')}, doc_id) - 1 AS v FROM documents)")
def class_variants(spark, sf_dir):
    """Languages as classes of samples: each row's position in its class, and the variant's digits."""
    return ranks.class_variants(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 42, [4, 7, 3])


@query("SELECT doc_id, CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 9 // 10 THEN 'dev' ELSE 'test' END AS split, r > n - greatest(1, n * 5 // 100) AS tail FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, (SELECT count(*) FROM documents) AS n FROM documents)")
def contiguous_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("one", F.lit(1))
    ranked = corpus.running_total(docs, "doc_id", "one", "r").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    return ranked.select("doc_id", splits.contiguous_split(F.col("r"), F.col("n")).alias("split"), splits.held_out_tail(F.col("r"), F.col("n")).alias("tail"))


@query("SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, CAST(t // k + (row_number() OVER (ORDER BY lang) - 1 < t % k)::INT AS BIGINT) AS n FROM (SELECT lang, sum(count(*)) OVER () + 3 AS t, count(*) OVER () AS k FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def class_plan(spark, sf_dir):
    """As many samples as documents, and three, in equal counts over the languages."""
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    total = docs.agg((F.count("*") + 3).alias("t"))
    return splits.class_counts(docs.select("lang").distinct().crossJoin(F.broadcast(total)), "lang", F.col("t"))  # one row


@query(f"SELECT sha256(text) AS sha, count(DISTINCT split) AS n_splits, count(*) AS n FROM ({_STRATIFIED}) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    docs = splits.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha")), "doc_id", "lang", 42)
    return splits.leaks(docs, "sha")


@query("SELECT DISTINCT a.sha FROM (SELECT sha256(text) AS sha FROM documents WHERE lang = 'en' AND source < 'src2') a JOIN (SELECT sha256(text) AS sha FROM documents WHERE source >= 'src2') b USING (sha)")
def cross_set_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    return docs.where("lang = 'en' and source < 'src2'").select("sha").intersect(docs.where("source >= 'src2'").select("sha"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination(spark, sf_dir):
    """Documents that hold an item word for word. Items meet documents by six of their words and not all by all."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), F.split("text", r"\s").alias("w"))
    head = lambda w: F.array_join(F.slice(w, 2, 6), " ")  # inner words: the outer ones may be glued to others
    short = items.where(F.size("w") < 8)
    keyed = items.where(F.size("w") >= 8).select("item_id", "item", F.xxhash64(head(F.col("w"))).alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = F.split("text", r"\s")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 5, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 6), " ")))
    # candidates by hash; texts only travel for hits
    hits = docs.withColumn("w", w).select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(keyed, "key").select("doc_id", "item_id", "item").distinct()
    exact = hits.join(docs, "doc_id").where(F.contains("text", "item")).select("doc_id", "item_id")
    few = docs.join(short, F.contains(docs["text"], F.col("item"))).select("doc_id", "item_id")
    return exact.union(few)


_ENTRIES = "(SELECT doc_id, sha256(text) AS sha256, lang, source FROM documents)"


@query(f"SELECT doc_id, sha256, lang FROM {_ENTRIES}")
def manifest_entries(spark, sf_dir):
    return splits.manifest(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query(f"SELECT sha256(string_agg(sha256, '' ORDER BY doc_id)) AS digest FROM {_ENTRIES}")
def manifest_digest_content(spark, sf_dir):
    return splits.digest_contents(splits.manifest(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"SELECT sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(10), '' ORDER BY doc_id)) AS digest FROM {_ENTRIES}")
def manifest_digest_ids(spark, sf_dir):
    return splits.digest_ids(table(spark, sf_dir, "documents").select("doc_id"))


@query(f"SELECT sha256(string_agg(sha256 || chr(0) || source || chr(0), '' ORDER BY doc_id)) AS digest FROM {_ENTRIES}")
def manifest_digest_nul(spark, sf_dir):
    return splits.digest_sources(splits.manifest(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "source")


@query(f"SELECT m.doc_id, m.sha256 AS want, f.sha256 AS got FROM (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM documents) m LEFT JOIN (SELECT * FROM {_ENTRIES} WHERE doc_id % 89 <> 3) f USING (doc_id) WHERE m.sha256 IS DISTINCT FROM f.sha256")
def manifest_mismatches(spark, sf_dir):
    """Entries whose file is missing or has other contents; both faults are made here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    want = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("want"))
    got = splits.manifest(docs.where("doc_id % 89 <> 3"), "doc_id", "text").withColumnRenamed("sha256", "got")
    return want.join(got, "doc_id", "left").where("not (want <=> got)")


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def label_coverage_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT d.lang, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def label_coverage(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


@query("SELECT quality, toxic, count(l.doc_id) AS n FROM (SELECT unnest([0, 0, 0, 1, 1, 1]) AS quality, unnest([0, 1, 2, 0, 1, 2]) AS toxic) LEFT JOIN labels l USING (quality, toxic) GROUP BY quality, toxic")
def label_confusion(spark, sf_dir):
    keys = spark.createDataFrame([(q, t) for q in (0, 1) for t in (0, 1, 2)], "quality int, toxic int")
    return splits.counts_with_zeros(table(spark, sf_dir, "labels"), keys, ["quality", "toxic"])


@query("SELECT r AS need FROM (SELECT unnest(['en', 'de', 'it', 'fr', 'pt']) AS r) WHERE r NOT IN (SELECT lang FROM documents)")
def required_coverage(spark, sf_dir):
    need = spark.createDataFrame([(x,) for x in ("en", "de", "it", "fr", "pt")], "need string")
    return need.join(table(spark, sf_dir, "documents").select(F.col("lang").alias("need")).distinct(), "need", "left_anti")


@query("SELECT lang, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
