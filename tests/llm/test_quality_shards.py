import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import hash_tree, quality_bands

ROWS = [(1, "the cat " * 40, None), (2, None, "a"), (3, "", "b"), (4, " \n\t", "c"), (5, "word", "d"), (5, "word", "d"), (None, "a #b *c\n a #b *c\n\nzé " + " ".join(f"w{i}" for i in range(40)), "e")]
ROWS += [(100 + i, f"text number {i} é", "x") for i in range(400)]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, shard string")


def brute(text):
    text = text or ""
    for c in "\t\n\v\f\r":
        words = text
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    hit = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_rules(spark):
    got = sorted((r.doc_id or 0, *r[1:7]) for r in quality_bands.quality_bands(frame(spark)).collect())
    assert got == sorted((i or 0, *brute(t)) for i, t, _ in ROWS)
    assert quality_bands.quality_bands(frame(spark).limit(0)).count() == 0


def test_bands():
    pack = zstandard.ZstdCompressor(level=3)
    import random

    rng = random.Random(3)
    noise = bytes(rng.randrange(33, 127) for _ in range(9000))
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000)).encode()
    assert not quality_bands.verdict(b"again and again " * 500, pack)[2]
    assert not quality_bands.verdict(noise, pack)[2]
    assert quality_bands.verdict(prose, pack)[2]
    assert not quality_bands.verdict(prose[:8192] + b"x" * 8192, pack)[2]
    assert quality_bands.verdict(b"", pack)[2]


def test_tree(spark):
    out = hash_tree.hash_tree_shards(frame(spark)).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(24))
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in ROWS)
    assert hash_tree.hash_tree_shards(frame(spark).limit(0)).count() == 0


def test_draws_match_python(spark):
    import hashlib
    import math

    def draw(key, name, w):
        return -math.log((int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12) / w

    def place(key, n):
        regions = hash_tree.tree(n)
        i = min(range(len(regions)), key=lambda i: draw(key, f"r{i}", sum(len(k) for k in regions[i])))
        j = min(range(len(regions[i])), key=lambda j: draw(key, f"r{i}k{j}", len(regions[i][j])))
        return min(regions[i][j], key=lambda leaf: draw(key, f"s{leaf[0]}", leaf[1]))[0]

    for r in hash_tree.hash_tree_shards(frame(spark)).collect():
        key = "null" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (place(key, 24), place(key, 25))


def test_weights_move_only_their_subtree(spark):
    docs = spark.range(3000).withColumn("id", F.col("id").cast("string"))
    out = hash_tree.placed(hash_tree.placed(docs, "id", "a", hash_tree.tree(24)), "id", "b", hash_tree.tree(24, {5: 3.0})).where("a <> b").collect()
    assert out and all(r.b // 8 == 0 for r in out)


@pytest.mark.parametrize("planned", [1, 10, 24])
def test_growth_takes_rows_only_into_the_new_shard(spark, planned):
    """From any number of shards on, again and again, with ids and the shard count alone deciding."""
    docs = spark.range(1500).withColumn("id", F.col("id").cast("string"))
    for n in range(planned, planned + 5):
        docs = hash_tree.placed(docs, "id", f"s{n}", hash_tree.tree(n, planned=planned), f"g{n}")
    rows = docs.collect()
    for n in range(planned, planned + 5):
        moved = [r for r in rows if r[f"g{n}"] != r[f"s{n}"]]
        assert moved and all(r[f"g{n}"] == n for r in moved)
        assert len(moved) == pytest.approx(1500 / (n + 1), rel=0.5)
        if n + 1 < planned + 5:
            assert all(r[f"g{n}"] == r[f"s{n + 1}"] for r in rows)


def test_growth_at_every_count_without_a_plan(spark):
    """The shard count alone decides: the grown shard is that of one more, and rows move only into it."""
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    last = None
    for n in [*range(1, 41)]:
        now = {r.doc_id: (r.shard, r.grown_shard) for r in hash_tree.laid_out(docs.withColumn("_k", F.col("doc_id").cast("string")), "_k", "shard", n, hash_tree.PLANNED, "grown_shard").collect()}
        assert all(g in (s, n) and 0 <= s < n for s, g in now.values())
        assert sum(g == n for _, g in now.values()) == pytest.approx(700 / (n + 1), abs=6 * (700 / (n + 1)) ** 0.5)
        if last:
            assert {k: s for k, (s, _) in now.items()} == last
        last = {k: g for k, (_, g) in now.items()}
    rows = hash_tree.hash_tree_shards(docs, 10).collect()
    assert {r.doc_id: r.grown_shard for r in rows} == {r.doc_id: r.shard for r in hash_tree.hash_tree_shards(docs, 11).collect()}


def test_tree_against_sql(spark, tmp_path):
    import duckdb

    frame(spark).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = sorted(map(str, map(tuple, hash_tree.hash_tree_shards(frame(spark)).collect())))
    assert got == sorted(map(str, con.execute(hash_tree.SQL).fetchall()))


def test_incompressible_text_is_rejected():
    import random
    import string

    pack, rng = zstandard.ZstdCompressor(level=3), random.Random(5)
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.printable[:94]):
        for n in (300, 700, 1000, 3000, 5000, 10_000, 60_000):
            words = " ".join("".join(rng.choices(alphabet, k=rng.randrange(4, 12))) for _ in range(n // 4))[:n]
            lines = "\n".join("".join(rng.choices(alphabet, k=76)) for _ in range(n // 76 + 1))[:n]
            assert not quality_bands.verdict(words.encode(), pack)[2] and not quality_bands.verdict(lines.encode(), pack)[2], (n, alphabet)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000)).encode()
    for n in (700, 3000, 5000):
        assert quality_bands.verdict(prose[:n], pack)[2]
    assert quality_bands.verdict(prose[:4096] + words.encode()[:900], pack)[1:] == (900 / 4996, True)
    assert not quality_bands.verdict(prose[:4096] + words.encode()[:2000], pack)[2]
