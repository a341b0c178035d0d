"""Operator 12: a Merkle manifest of a data set by Pregel-style supersteps on RDDs.

Method. Nodes of a level are numbered within their group (a source; then all sources) from 0. In a superstep upwards every child
messages its parent, the node numbered by a third of its own number; a parent that has all its children hashes them and forwards
itself to the next superstep, and the only node of a group waits. In the reverse supersteps every parent sends each child its own
path and the child's siblings, down to the leaves, where the root is computed again from leaf and path.

Nodes are dealt out by blocks of 3 ** HOPS numbers. All children of a parent up to HOPS levels above are in its block, so that many
supersteps run one after another on sorted partitions, as a stream that holds one parent's children at a time; only one node of a
block is dealt out again. A block is bounded, so a source of any size is spread over all tasks. Downwards a block gets the path of
its top as one message, so no path travels to each leaf. Every round of HOPS levels is a written table: a lost executor costs no
more than the round. Only digests are shuffled; texts are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._scratch import Scratch

ARITY = 3
HOPS = 7
SPAN = ARITY**HOPS
NODE = "grp string, pos long, n long, digest string"
PATH = "grp string, pos long, path array<string>, subroot string, root string"


def h(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None) -> DataFrame:
    """doc_id, grp (a name for the source that sorts as sources do, null first), leaf, and changed: the leaf of a row that was
    tampered with, if the text differs. tampered: the text as it is now."""
    leaf = F.sha2(F.concat(*[_field(F.col(c)) for c in fields]), 256)
    now = F.lit(None).cast("string") if tampered is None else tampered
    changed = F.when(now != F.col("text"), F.sha2(F.concat(*[_field(now if c == "text" else F.col(c)) for c in fields]), 256))
    group = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("grp"), leaf.alias("leaf"), changed.alias("changed"))


def numbered(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0 in each grp, by order) and n (rows of the grp). Ranges of the order are sorted in tasks of their
    own and written; a table of counts by (grp, range) has what comes before. Equal rows are dealt out too."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    # written with the number of each row in its task, so that it stays what it is
    kept = scratch.keep(tied.repartitionByRange("grp", *order, "tie").sortWithinPartitions("grp", *order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()))
    kept = kept.withColumn("part", F.shiftright("at", 33))
    counts = kept.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    group = W.partitionBy("grp")
    before = counts.select("grp", "part", (F.sum("k").over(group.orderBy("part")) - F.col("k") - F.col("first")).alias("shift"), F.sum("k").over(group).alias("n"))
    return kept.join(before, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def forward(nodes: Iterable[tuple]) -> Iterator[tuple]:
    """One superstep upwards over sorted (grp, pos, n, digest): children message their parents, complete parents go on."""
    for (group, parent), inbox in groupby(nodes, key=lambda x: (x[0], x[1] // ARITY)):
        messages = list(inbox)
        n = messages[0][2]
        if n == 1:
            yield messages[0]
            continue
        if len(messages) != min(ARITY, n - ARITY * parent):
            raise ValueError(f"a parent misses children: {group}, {parent}")
        yield group, parent, -(-n // ARITY), h(x[3] for x in messages)


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / SPAN).cast("long"))


def risen(nodes: DataFrame) -> DataFrame:
    """The nodes HOPS levels above, or the root of a group that has fewer levels."""
    rdd = _blocks(nodes).repartition("grp", "block").sortWithinPartitions("grp", "pos").select("grp", "pos", "n", "digest").rdd.map(tuple)
    for _ in range(HOPS):
        rdd = rdd.mapPartitions(forward, preservesPartitioning=True)
    return nodes.sparkSession.createDataFrame(rdd, NODE, verifySchema=False)


def all_rounds(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes: the given ones, then those of every round, until each group has its root."""
    tables = [nodes.select("grp", "pos", "n", "digest")]
    while True:
        tables.append(scratch.keep(risen(tables[-1])))
        if (tables[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return tables


def sent_down(block: list[str], n: int, path: list[str]) -> list[list[str]]:
    """The paths of a block's nodes: what stands before and behind a node among its siblings, level by level. block: digests;
    n: nodes of the whole group on this level; path: that of the block's top."""
    levels = []
    for _ in range(HOPS):
        if n == 1:
            break
        levels.append(block)
        block, n = [h(block[i : i + ARITY]) for i in range(0, len(block), ARITY)], -(-n // ARITY)
    paths = [path] * len(block)
    for level in reversed(levels):  # a superstep downwards: each parent messages its children
        paths = [["".join(level[i - i % ARITY : i]), "".join(level[i + 1 : i - i % ARITY + ARITY]), *paths[i // ARITY]] for i in range(len(level))]
    return paths


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to. A level without siblings hashes the node alone."""
    for i in range(0, len(path), 2):
        leaf = h((path[i], leaf, path[i + 1]))
    return leaf


def lowered(nodes: DataFrame, tops: DataFrame, more: list[str], make, schema: str) -> DataFrame:
    """Reverse supersteps of one round. nodes: grp, pos, n, digest and more; tops: PATH rows of the blocks' tops, numbered as
    their blocks. make(node, path, subroot, root) gives a row."""
    blank = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in more]
    none = F.lit(None)
    children = _blocks(nodes).select("grp", "block", "pos", "n", "digest", none.cast("array<string>").alias("path"), none.cast("string").alias("subroot"), none.cast("string").alias("root"), *more)
    above = tops.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), none.cast("long").alias("n"), none.cast("string").alias("digest"), "path", "subroot", "root", *blank)
    both = children.union(above).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")

    def run(rows):
        for _, block in groupby(rows, key=lambda x: (x[0], x[1])):
            top, *inside = block
            if top[2] != -1:
                raise ValueError(f"a block has no path: {top[0]}, {top[1]}")
            for node, path in zip(inside, sent_down([x[4] for x in inside], inside[0][3], top[5]), strict=True):
                yield make(node, path, top[6], top[7])

    return nodes.sparkSession.createDataFrame(both.rdd.mapPartitions(run), schema, verifySchema=False)


def _as_path(node, path, subroot, root):
    return node[0], node[2], path, subroot, root


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (the digest of all siblings from leaf to root), folded_root (of the leaf as it
    is now and the siblings), verified, for each row. docs: doc_id, source, lang, n_chars, text; others are not read.
    tampered: the texts as they are now, None if they are as they were.

    A null field is a dash in its leaf; a null source is a source of its own and the first. In a source leaves ascend by
    doc_id, nulls first, and equal ids by leaf; equal rows have proofs of their own. A single leaf is its source's subroot,
    a single source's subroot the root, and a leaf without siblings has the proof of no digests. An empty table has no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "op12")
    rows = scratch.keep(leaves(docs, tampered=tampered))
    first = numbered(scratch, rows, ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    lower = all_rounds(scratch, first)
    subroots = lower[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    sources = numbered(scratch, subroots, ["name"])
    upper = all_rounds(scratch, sources)
    top = upper[-1].select("grp", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[1:-1]):
        top = scratch.keep(lowered(nodes, top, [], _as_path, PATH))
    top = scratch.keep(lowered(sources, top, ["name"], lambda node, path, _, root: (node[8], 0, path, node[4], root), PATH))
    for nodes in reversed(lower[1:-1]):
        top = scratch.keep(lowered(nodes, top, [], _as_path, PATH))

    def verified(node, path, subroot, root):
        now = fold(node[9] or node[4], path)
        return node[8], node[4], subroot, root, h(path), now, now == root

    return lowered(first, top, ["doc_id", "changed"], verified, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_pregel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every second id, by checksum, lose their line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


#: Levels that the SQL below has for leaves of one source, and for sources: 3 to that power at most.
_LEVELS, _TOPS = 12, 6


def _tree(name: str, start: str, key: str, levels: int) -> list[str]:
    """Common tables: {name}0 to {name}{levels} with key, pos, d, n, l and r (siblings before and behind)."""
    sides = f"CASE WHEN n > 1 AND pos % 3 > 0 THEN (CASE WHEN pos % 3 > 1 THEN lag(d, 2) OVER w ELSE '' END) || lag(d) OVER w ELSE '' END AS l, CASE WHEN n > 1 AND pos % 3 < 2 THEN coalesce(lead(d) OVER w, '') || (CASE WHEN pos % 3 = 0 THEN coalesce(lead(d, 2) OVER w, '') ELSE '' END) ELSE '' END AS r"
    out = [f"{name}0 AS MATERIALIZED (SELECT *, {sides} FROM ({start}) WINDOW w AS (PARTITION BY {key} ORDER BY pos))"]
    for i in range(levels):
        up = f"SELECT {key}, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d, (any_value(n) + 2) // 3 AS n FROM {name}{i} GROUP BY {key}, pos // 3"
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT *, {sides} FROM ({up}) WINDOW w AS (PARTITION BY {key} ORDER BY pos))")
    return out


def _sql() -> str:
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = lambda text: " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text)))
    ctes = [
        "tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t)",
        "ids AS (SELECT *, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: ('0x' || x)::BIGINT)) AS b FROM documents)",
        "now AS (SELECT ids.* EXCLUDE (b), CASE WHEN xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS BIGINT) + 1])), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text_now FROM ids, tab)",
        f"leaf AS (SELECT doc_id, coalesce('1' || source, '0') AS g, sha256({fields('text')}) AS d, sha256({fields('text_now')}) AS changed FROM now)",
        "place AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf)",
        *_tree("n", "SELECT g, pos, d, n FROM place", "g", _LEVELS),
        *_tree("s", f"SELECT 0 AS z, row_number() OVER (ORDER BY g) - 1 AS pos, d, count(*) OVER () AS n, g FROM n{_LEVELS}", "z", _TOPS),
        "f0 AS (SELECT place.*, d AS d0, changed AS f, '' AS proof, pos AS spot FROM place)",
    ]
    step = lambda n: f"CASE WHEN {n}.n = 1 THEN f ELSE sha256({n}.l || f || {n}.r) END AS f, proof || {n}.l || {n}.r AS proof"
    for i in range(_LEVELS):
        ctes.append(f"f{i + 1} AS (SELECT f{i}.* EXCLUDE (f, proof, spot), {step(f'n{i}')}, spot // 3 AS spot FROM f{i} JOIN n{i} ON n{i}.g = f{i}.g AND n{i}.pos = spot)")
    ctes.append(f"g0 AS (SELECT f{_LEVELS}.* EXCLUDE (spot), s0.pos AS spot, s0.d AS subroot FROM f{_LEVELS} JOIN s0 ON s0.g = f{_LEVELS}.g)")
    for i in range(_TOPS):
        ctes.append(f"g{i + 1} AS (SELECT g{i}.* EXCLUDE (f, proof, spot), {step(f's{i}')}, spot // 3 AS spot FROM g{i} JOIN s{i} ON s{i}.pos = spot)")
    last = f"g{_TOPS}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, d0 AS leaf, subroot, s{_TOPS}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = s{_TOPS}.d AS verified FROM {last}, s{_TOPS}"


SQL = _sql()
