"""Operator 7: sharding by a hierarchical weighted hash tree.

Method. Shards are leaves of a tree of regions, racks and shards. From the root down, each child of the node reached draws
-ln(u) / weight for the document, u being a hash of the document's id and the child's name in (0, 1), and the least draw wins;
a child's weight is the sum of its leaves'. Changing a weight changes only this child's draw (and those of its ancestors), so
documents move only into or out of subtrees whose weights change.

One more shard takes documents only into itself, at any count. A tree is laid out for ``planned`` shards, in regions of eight, and
each shard beyond is a region of its own, which draws against whole regions. With fewer shards than planned the same tree
stands, and a document that draws a shard that is not there yet draws again, TRIES times in all; then all shards that are there
draw at once, as if each were a region. A shard that comes to be thus takes the documents that drew it before the one they had.

All is native: the draws of a node's children are a literal array, one projection for each level, before any shuffle. Only
ids, sizes and checksums are shuffled, for the slots; these are numbered within (shard, block of ids) and get the block's
offset added, so no task sees a whole shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

REGION, RACK = 8, 4  # shards of a region and of a rack
BLOCKS = 64
PLANNED = 24
TRIES = 3
DIGITS = 12  # hex digits of a draw


Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, weights: dict[int, float] | None = None, planned: int | None = None) -> Tree:
    """Regions of racks of (shard, weight), for shards 0 to shards - 1, laid out for ``planned`` ones (or all)."""
    leaves = [(s, float((weights or {}).get(s, 1.0))) for s in range(shards)]
    planned = min(shards, shards if planned is None else planned)
    regions = [leaves[i : min(i + REGION, planned)] for i in range(0, planned, REGION)] + [[leaf] for leaf in leaves[planned:]]
    return [[r[i : i + RACK] for i in range(0, len(r), RACK)] for r in regions]


def _weight(racks: list[list[tuple[int, float]]]) -> float:
    return sum(w for rack in racks for _, w in rack)


def _levels(t: Tree) -> tuple[list, list, list]:
    """(name, weight, number) of the regions, of each region's racks, and of each rack's shards (racks numbered through)."""
    regions = [(f"r{i}", _weight(racks), i) for i, racks in enumerate(t)]
    racks, shards = [], []
    for i, r in enumerate(t):
        racks.append([(f"r{i}k{j}", _weight([rack]), len(shards) + j) for j, rack in enumerate(r)])
        shards += [[(f"s{s}", w, s) for s, w in rack] for rack in r]
    return regions, racks, shards


def _draws(children: str, key: str) -> str:
    """SQL of the least (draw, number) among children, an array of (name, weight, number); ties go to the first number."""
    d = f"-ln((cast(conv(left(md5(concat(cast({key} as string), ':', x.name)), {DIGITS}), 16, 10) as double) + 0.5) / {16**DIGITS}D) / x.weight"
    return f"array_min(transform({children}, x -> named_struct('d', {d}, 'i', x.number)))"


def _literal(children: list[tuple[str, float, int]]) -> str:
    return "array(" + ", ".join(f"named_struct('name', '{n}', 'weight', {w!r}D, 'number', {i})" for n, w, i in children) + ")"


def placed(df: DataFrame, key: str, name: str, t: Tree, grown: str | None = None) -> DataFrame:
    """df with the shard of each key, and with ``grown`` that of the tree with one more shard, a region of its own."""
    regions, racks, shards = _levels(t)
    nested = lambda levels: "array(" + ", ".join(map(_literal, levels)) + ")"
    df = df.withColumn("_region", F.expr(_draws(_literal(regions), key)))
    df = df.withColumn("_rack", F.expr(_draws(f"element_at({nested(racks)}, _region.i + 1)", key)))
    df = df.withColumn(name, F.expr(_draws(f"element_at({nested(shards)}, _rack.i + 1)", key) + ".i"))
    if grown:
        new = 1 + max(s for r in t for rack in r for s, _ in rack)
        more = _draws(_literal([(f"r{len(t)}", 1.0, len(t))]), key)
        df = df.withColumn("_more", F.expr(more)).withColumn(grown, F.expr(f"if(_more.d < _region.d, {new}, {name})")).drop("_more")
    return df.drop("_region", "_rack")


def laid_out(df: DataFrame, key: str, name: str, shards: int, planned: int, grown: str, weights: dict[int, float] | None = None) -> DataFrame:
    """df with the shard of each key among ``shards`` ones, and that with one more, whatever the count."""
    if shards >= planned:
        return placed(df, key, name, tree(shards, weights, planned), grown)
    whole, tries = tree(planned, weights), [f"_try{i}" for i in range(TRIES)]
    for i, c in enumerate(tries):
        df = df.withColumn("_key", F.concat(key, F.lit(f"/{i}")) if i else F.col(key))
        df = placed(df, "_key", c, whole)
    df = placed(df, key, "_any", tree(shards, weights, 0), "_any_more")
    first = lambda n, rest: F.coalesce(*[F.when(F.col(c) < n, F.col(c)) for c in tries], F.col(rest))
    return df.withColumn(name, first(shards, "_any")).withColumn(grown, first(shards + 1, "_any_more")).drop("_key", "_any", "_any_more", *tries)


def hash_tree_shards(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", planned: int = PLANNED, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law ('key'), shard, slot (gapless from 0 in each shard), grown_shard
    (the shard if there were one more).

    Null texts have size 8 and the checksum of no bytes. A null id is hashed as the word null. Repeated rows go to one
    shard and get slots of their own. Other columns are not read. An empty table gives an empty result. ``planned``: the
    number of shards that the tree is laid out for, the same at every count: ids and the shard count decide, and growing by one
    moves rows only into the new shard, again and again.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("_k", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = laid_out(rows, "_k", "shard", shards, planned, "grown_shard", weights)
    rows = rows.withColumn("_b", F.expr(f"cast(conv(left(md5(concat(_k, ':b')), 4), 16, 10) as int) % {BLOCKS}")).drop("_k")
    counts = rows.groupBy("shard", "_b").count()
    before = counts.withColumn("_o", F.sum("count").over(W.partitionBy("shard").orderBy("_b")) - F.col("count")).drop("count")
    inner = F.row_number().over(W.partitionBy("shard", "_b").orderBy("doc_id", "size", "text_crc32")) - 1
    # at most shards * BLOCKS rows
    rows = rows.withColumn("_r", inner).join(F.broadcast(before), ["shard", "_b"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_o") + F.col("_r")).cast("long").alias("slot"), "grown_shard")


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(children: str) -> str:
    """The least draw among children, in the oracle's dialect."""
    d = f"-ln((('0x' || left(md5(k || ':' || x.name), {DIGITS}))::BIGINT::DOUBLE + 0.5) / {16**DIGITS}::DOUBLE) / x.weight"
    return f"list_min(list_transform({children}, lambda x: {{'d': {d}, 'i': x.number}}))"


def _list(children: list[tuple[str, float, int]]) -> str:
    return "[" + ", ".join(f"{{'name': '{n}', 'weight': {w!r}::DOUBLE, 'number': {i}}}" for n, w, i in children) + "]"


_REGIONS, _RACKS, _SHARDS = _levels(tree(24))
SQL = f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
a AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS s FROM documents),
b AS (SELECT *, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::BIGINT)) AS b FROM a),
c AS (SELECT doc_id, CAST(strlen(s) + 8 AS BIGINT) AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS BIGINT) + 1])), 4294967295) AS text_crc32,
  k, ('0x' || left(md5(k || ':b'), 4))::BIGINT % {BLOCKS} AS b, {_sql(_list(_REGIONS))} AS region, {_sql(_list([("r3", 1.0, 3)]))} AS more FROM b, tab),
d AS (SELECT *, {_sql("[" + ", ".join(map(_list, _RACKS)) + "][region.i + 1]")} AS rack FROM c),
e AS (SELECT *, CAST({_sql("[" + ", ".join(map(_list, _SHARDS)) + "][rack.i + 1]")}.i AS INTEGER) AS shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY b, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CASE WHEN more.d < region.d THEN 24 ELSE shard END AS grown_shard FROM e
"""
