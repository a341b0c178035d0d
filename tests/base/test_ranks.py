import random

from pyspark.sql import functions as F

from corpusloom.operators import corpus, ranks, splits, windows


def test_ranks_with_ties_nulls_and_a_large_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.randrange(0, 5000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = ranks.ranked(df, ["g"], F.floor(F.col("v") / 100), ["v"], total="n").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r["rank"], r.v, r.n))
    for g, x in by.items():
        want = sorted(v for k, v in rows if k == g)
        assert [(i + 1, v, len(want)) for i, v in enumerate(want)] == sorted(x)
    assert len(got) == len(rows) and ranks.ranked(df.limit(0), ["g"], F.col("v"), ["v"]).count() == 0


def test_split_positions_are_gapless(spark):
    df = spark.range(997).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("c"))
    rows = splits.split_positions(df, "id", "c", 3).collect()
    same = {r.id: r.split for r in splits.stratified_split(df, "id", "c", 3).collect()}
    assert {r.id: r.split for r in rows} == same and len(rows) == 997
    for s in ("train", "dev", "test"):
        mine = sorted((r.pos, r.c or "") for r in rows if r.split == s)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [c for _, c in mine] == sorted(c for _, c in mine)


def test_route_keeps_the_first(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("t"), (F.col("id") % 3).alias("e"))
    kept = windows.route(df, "e", "t", F.lit(100), block=64).where("kept").groupBy("e").agg(F.count("*").alias("n"), F.max("t").alias("m")).collect()
    want = {e: sorted(i * 37 % 5000 for i in range(5000) if i % 3 == e)[99] for e in range(3)}
    assert {r.e: r.m for r in kept} == want and all(r.n == 100 for r in kept)


def test_running_total_over_many_blocks(spark):
    df = spark.range(3000).select((F.col("id") * 5).alias("i"), F.lit(2).alias("v"))
    rows = corpus.running_total(df, "i", "v", "s", block=8).orderBy("i").collect()
    assert [r.s for r in rows] == [2 * (k + 1) for k in range(3000)]
