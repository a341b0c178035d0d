"""Operator 1: Jaccard join of documents over word n-grams, by token-combination prefixes.

Method. A document is its set of distinct 64-bit hashes of k lower-cased words. Tokens are ordered by class: rare, then
middling, then frequent, by hash within each. A similar document lacks at most ``tau`` tokens of a set, so a prefix of
tau + 1 tokens below the frequent class shares one with it. Where the prefix has to go on into the frequent class, that
class is dealt into parts by hash; each part needs one token more, and pairs of its tokens are indexed instead of single
ones: if no rarer token is shared, more frequent tokens are shared than there are parts, so two of them lie in one part. The
number of parts grows with the set, by size class, so that there are about ten pairs for a part; a set indexes its own
class and the next if a partner may be there. What two prefixes share bounds what two sets can share; pairs within that
bound are verified on their whole sets of shingles, made anew from the texts. Shingles are told apart by 64-bit hashes, and
equal sets by two sums of them.

Scale. The classes come first from a table of counts of fixed size, over all documents; two bits for each cell are broadcast
(4 MB). Where the corpus outgrows that table, tokens that it calls rare may still have long lists: a token that more than
HEAVY documents index is then frequent too, known by key. Documents that index such tokens are indexed anew without them,
until no document indexes one, so that every document knows the class of each token that it indexes. Any classes give
complete results; they set the cost. Equal sets are one node. In a list of documents with a common signature, every document is first compared with one
of them (that with the fewest tokens below the frequent class: of near copies, the one that is most like the others), and the
links found make components; only documents of the same list that are then in different components are compared pair by
pair. So a group of n near copies costs about n comparisons and not n squared, and no link between components is lost. Lists
of single tokens (HEAVY documents at most) that hold the same documents are one list with a weight, so a pair is made once
for all of them. A list of a frequent pair has no bound: it is dealt into blocks of bounded size, which are looked at on
arrays, and pairs are made only where the parities of two sets leave them similar. Links inside a component are not all made, so links are not counted. Hot keys (a set that many rows have, a list or a document
with many pairs) are found by their counts and dealt out over several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _kernels as K
from ._components import components
from ._scratch import Scratch, hot_counts, hot_values, only_keys, small_batches, spread_join
from ._tables import count_table

CELL_BITS = 24  # of the table of counts
HEAVY = 256  # documents that may index a token by itself


def _cell(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> K.U64(64 - bits)).astype(np.int64)


def cell_classes(docs: DataFrame, text: str, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each cell: is it above what chance adds to a rare token's cell, and is it far above the mean?"""
    of = lambda batch: (_cell(np.concatenate(K.shingle_sets(data, offsets, k)), bits) for _, _, data, offsets in K.slices(batch.column(0)))
    counts = count_table(docs.select(text), 1 << bits, of)
    mean = counts.mean()
    return np.packbits(counts > 3 + mean + 2.5 * np.sqrt(mean)), np.packbits(counts > 16 + 2 * mean)


def size_class(n: int) -> int:
    return int(n).bit_length()


def _need(n: int, percent: int) -> int:
    """Tokens that a prefix needs if no one is of the frequent class."""
    return n - -(-percent * n // 100) + 1


def signatures(tokens: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of single tokens below the frequent class, and of pairs of frequent ones: sets of the wanted similarity share
    one of them.

    tokens: sorted and distinct; level: 0, 1 or 2 (frequent) for each. Sets of one or two tokens are left out if frequent
    only: at 67 percent or more they are similar to equal sets alone.
    """
    n = len(tokens)
    need = _need(n, percent)
    rare = np.concatenate([tokens[level == 0], tokens[level == 1]])
    if len(rare) >= need:
        return rare[:need], np.zeros(0, np.uint64)
    often, pairs = tokens[level == 2], []
    for c in {size_class(n), size_class(100 * n // percent)}:
        parts = max(1, (1 << c) // 32)
        part = (often * K.U64(0x9E3779B97F4A7C15) >> K.U64(33)) % K.U64(parts)
        first = np.zeros(len(often), bool)
        first[np.unique(part, return_index=True)[1]] = True
        gained = np.cumsum(~first)
        m = int(np.searchsorted(gained, need - len(rare))) + 1
        x, p = often[:m], part[:m]
        order = np.argsort(p, kind="stable")
        x, p = x[order], p[order]
        step = 1
        while len(x) > step and (same := p[step:] == p[:-step]).any():
            with np.errstate(over="ignore"):
                pairs.append(K.mix(x[:-step][same] * K.U64(3) + x[step:][same], 7000 + c))
            step += 1
    return rare, np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)


BUCKETS, LANE, MOST = 9, 20, (1 << 17) - 1


def sketch(often: np.ndarray) -> tuple[int, ...]:
    """How many of the frequent tokens fall into each of nine buckets, in three words of three lanes."""
    counts = np.minimum(np.bincount(((often >> K.U64(20)) % K.U64(BUCKETS)).astype(np.int64), minlength=BUCKETS), MOST).tolist()
    return tuple(sum(c << LANE * i for i, c in enumerate(counts[j : j + 3])) for j in (0, 3, 6))


PARITY = 16  # words of 64 bits


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY cells, whether an odd number of tokens fall into it. Two sets differ in at least as many tokens
    as their parities do in bits."""
    cells = 64 * PARITY
    counts = np.bincount((tokens >> K.U64(30) & K.U64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


ROW = "doc_id long, n long, h1 long, h2 long, meta long, s1 long, s2 long, s3 long, par array<long>, rare array<long>, often array<long>"


def _index(k: int, percent: int, cells: int, bits):
    """Sizes, sums of hashes, classes and signatures of texts. A third column: tokens known to be frequent by key."""
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "h1", "h2", "meta", "s1", "s2", "s3")), *((c, pa.list_(pa.int64())) for c in ("par", "rare", "often"))])

    def run(batches):
        level = np.unpackbits(bits.value[0])
        level += np.unpackbits(bits.value[1])
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                heavy = batch.column(2).slice(a, b - a).to_pylist() if batch.num_columns > 2 else [None] * (b - a)
                fixed, par, rare, often = [], [], [], []
                for tokens, known in zip(K.shingle_sets(data, offsets, k), heavy, strict=True):
                    of = level[_cell(tokens, cells)]
                    if known:
                        of[np.isin(tokens, np.array(known, np.int64).view(np.uint64))] = 2
                    r, o = signatures(tokens, of, percent)
                    with np.errstate(over="ignore"):
                        sums = [K.mix(tokens, salt).sum(dtype=np.uint64).astype(np.uint64).view(np.int64) for salt in (11, 13)]
                    whole = len(tokens) > 0 and len(r) == _need(len(tokens), percent)
                    meta = len(tokens) << 32 | int((of == 2).sum()) << 1 | int(whole)
                    fixed.append((len(tokens), *map(int, sums), meta, *sketch(tokens[of == 2])))
                    par.append(parity(tokens))
                    rare.append(r.view(np.int64))
                    often.append(o.view(np.int64))
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32), pa.array(np.concatenate(v))) for v in (par, rare, often)]
                numbers = np.array(fixed, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), *(pa.array(np.ascontiguousarray(numbers[:, j])) for j in range(7)), *lists], schema=schema)

    return K.tidy(run)


def _verify(k: int, percent: int):
    def run(batches):
        for batch in batches:
            cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            keep = []
            left: tuple = (None, None)
            for a, b, data, offsets in K.slices(cols["tb"]):
                for i, right in enumerate(K.shingle_sets(data, offsets, k), a):
                    mine = cols["ta"][i].as_py()
                    if left[0] != mine:
                        (_, _, d, o), = K.slices(pa.array([mine]))
                        left = mine, K.shingle_sets(d, o, k)[0]
                    both = len(np.intersect1d(left[1], right, assume_unique=True))
                    keep.append(bool(both) and 100 * both >= percent * (len(left[1]) + len(right) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([cols["a"].filter(mask), cols["b"].filter(mask)], ["a", "b"])

    return K.tidy(run)


def _links(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar. Texts travel for the documents in pairs only; that of a document
    with very many pairs goes to several tasks."""
    texts = only_keys(docs, "doc_id", pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct(), "x")
    right, left = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    found = spread_join(pairs, right, ["b"], "b", hot_values(pairs, "b"), F.col("a"))
    found = spread_join(found, left, ["a"], "a", hot_values(pairs, "a"), F.col("b"))
    return found.select("a", "b", "ta", "tb").mapInArrow(_verify(k, percent), "a long, b long")


#: Of ``meta``: tokens of a set, frequent ones among them, and whether its prefix stays below the frequent class.
_N, _F, _PURE = "shiftright({0}, 32)", "(shiftright({0}, 1) & 2147483647)", "(({0} & 1) = 1)"


def _near(x: str, y: str, percent: int, often: str) -> str:
    """SQL: may two sets be similar, by their sizes and, where ``often`` holds, without a common rarer token?"""
    n = [_N.format(c) for c in (x, y)]
    f = [_F.format(c) for c in (x, y)]
    return f"100 * least({n[0]}, {n[1]}) >= {percent} * greatest({n[0]}, {n[1]}) and (not ({often}) or {100 + percent} * least({f[0]}, {f[1]}) >= {percent} * ({n[0]} + {n[1]}))"


def _sharing(percent: int) -> str:
    """SQL on rows a and b of phase two: may two sets without a common rarer token be similar?

    They share at most the frequent tokens of a, less what a has more of than b in each bucket. All lanes of a word are
    subtracted at once: with a bit on top of each, that stays where a has as many as b or more.
    """
    top, unit = (sum(1 << LANE * i + k for i in range(3)) for k in (LANE - 1, 0))
    d = [f"((s{j}_a | {top}L) - s{j}_b)" for j in (1, 2, 3)]
    more = "(" + " + ".join(f"({x} & ((shiftright({x}, {LANE - 1}) & {unit}L) * {(1 << LANE - 1) - 1}))" for x in d) + ")"
    lanes = " + ".join(f"(shiftright({more}, {LANE * i}) & {(1 << LANE) - 1})" for i in range(3))
    n = [_N.format(f"meta_{c}") for c in "ab"]
    return f"{100 + percent} * ({_F.format('meta_a')} - ({lanes})) >= {percent} * ({n[0]} + {n[1]}) or greatest({n[0]}, {n[1]}) > {MOST}"


def _differing(percent: int) -> str:
    """SQL on rows a and b: may two sets be similar, as their parities show in how many tokens they differ at least?"""
    n = " + ".join(_N.format(f"meta_{c}") for c in "ab")
    bits = " + ".join(f"bit_count(par_a[{i}] ^ par_b[{i}])" for i in range(PARITY))
    return f"{100 + percent} * (({n}) - ({bits})) >= {2 * percent} * ({n})"


BLOCK = 1024  # documents of a part of a long list
LOOK = 1 << 17  # pairs looked at at once
_COLS = ("sig", "i", "j", "part", "doc_id", "meta", "label", "s1", "s2", "s3")


def _alike(rows: dict[str, np.ndarray], percent: int):
    """Pairs (a, ma, b, mb) of rows of one block that may be similar: what ``_near``, ``_sharing`` and ``_differing`` say, on
    arrays. A block (sig, i, j) is a run of rows; of two different parts, pairs are made between these only."""
    sig, i, j, part, ids, meta, label = (rows[c] for c in _COLS[:7])
    n, f = meta >> 32, meta >> 1 & 0x7FFFFFFF
    lanes = np.stack([rows[c] >> LANE * x & (1 << LANE) - 1 for c in ("s1", "s2", "s3") for x in range(3)], 1)
    heads = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    follow = np.repeat(np.append(heads[1:], len(sig)), np.diff(np.append(heads, len(sig)))) - np.arange(len(sig)) - 1
    upto, low = np.cumsum(follow), 0
    while low < len(sig):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - follow[low] + LOOK, side="right")))
        many = follow[low:high]
        x = np.repeat(np.arange(low, high), many)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
        low = high

        on = (label[x] != label[y]) & (ids[x] != ids[y]) & ((i[x] == j[x]) | (part[x] != part[y]))
        x, y = x[on], y[on]
        on = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        on &= (100 + percent) * np.minimum(f[x], f[y]) >= percent * (n[x] + n[y])
        x, y = x[on], y[on]
        bits = np.bitwise_count(rows["par"][x] ^ rows["par"][y]).sum(1, dtype=np.int64)
        on = (100 + percent) * (n[x] + n[y] - bits) >= 2 * percent * (n[x] + n[y])
        x, y = x[on], y[on]
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        more = np.maximum(lanes[x] - lanes[y], 0).sum(1)
        on = ((100 + percent) * (f[x] - more) >= percent * (n[x] + n[y])) | (np.maximum(n[x], n[y]) > MOST)
        x, y = x[on], y[on]
        if len(x):
            yield np.unique(np.stack([ids[x], meta[x], ids[y], meta[y]], 1), axis=0)


def _look(percent: int):
    """``_alike`` over sorted rows. A block, of some 2 * BLOCK rows, may begin in one batch and end in another."""

    def run(batches):
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {x.name: batch.column(k) for k, x in enumerate(batch.schema)}
            rows = {c: col[c].to_numpy(zero_copy_only=False) for c in _COLS}
            rows["par"] = col["par"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, PARITY)
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            other = np.flatnonzero((rows["sig"] != rows["sig"][-1]) | (rows["i"] != rows["i"][-1]) | (rows["j"] != rows["j"][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = {c: v[cut:].copy() for c, v in rows.items()}
            if cut:
                yield from found({c: v[:cut] for c, v in rows.items()})
        if held is not None:
            yield from found(held)

    def found(rows):
        for pairs in _alike(rows, percent):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(4)], ["a", "ma", "b", "mb"])

    return K.tidy(run)


def _in_long_lists(left: DataFrame, open_: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, ma, b, mb, w = 0) of documents of one list of a frequent pair that are in different components and may be
    similar. left: a row for each document and list; open_: sig and docs, the number of documents in the list.

    A list is dealt into parts of about ``block`` documents by hash, and every two parts, and every one, are a block of their
    own, so no task has a whole long list, and the work for a row is bounded.
    """
    parts = F.ceil(F.col("docs") / block).cast("int")
    rows = left.join(open_.select("sig", parts.alias("parts")), "sig").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)"))
    rows = rows.withColumn("x", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("i", F.least("part", "x")).withColumn("j", F.greatest("part", "x"))
    rows = rows.select(*_COLS, "par").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return rows.mapInArrow(_look(percent), "a long, ma long, b long, mb long").withColumn("w", F.lit(0))


def _in_short_lists(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, ma, b, mb) of documents that share single tokens and are in different components, with the number w of lists
    that hold just the same documents. Lists have HEAVY documents at most."""
    members = posts.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("doc_id", "meta", "label"))).alias("m"), F.min("label").alias("x"), F.max("label").alias("y"))
    lists = members.where("x <> y").groupBy("m").agg(F.count("*").alias("w"))
    # two explodes run as generated code; nested lambdas are interpreted
    pairs = lists.select("m", "w", F.explode("m").alias("p")).select("p", "w", F.explode("m").alias("q"))
    pairs = pairs.where(f"q.doc_id > p.doc_id and q.label <> p.label and {_near('p.meta', 'q.meta', percent, 'false')}")
    return pairs.select(F.col("p.doc_id").alias("a"), F.col("p.meta").alias("ma"), F.col("q.doc_id").alias("b"), F.col("q.meta").alias("mb"), "w")


def _possible(pairs: DataFrame, percent: int, share: float) -> DataFrame:
    """The distinct pairs (a, b) that can be similar, from rows with the number w of single tokens that they share.

    A prefix below the frequent class shows all of what it shares with another prefix that does not end before it; so what
    two sets share is at most that and the tokens behind the prefix. Where both go on into the frequent class, they show
    all rarer tokens; so it is at most what they share of these, and the frequent tokens of one.
    """
    x, y = "ma", "mb"
    behind = [f"if({_PURE.format(c)}, ceil({percent} * {_N.format(c)} / 100) - 1, null)" for c in (x, y)]
    rest = f"coalesce(greatest({behind[0]}, {behind[1]}), least({_F.format(x)}, {_F.format(y)}))"
    need = f"ceil({percent} * ({_N.format(x)} + {_N.format(y)}) / {100 + percent})"
    return (
        pairs.groupBy("a", "b", "ma", "mb")
        .agg(F.sum("w").alias("shared"))
        .where(f"shared >= {share}D * ({need} - {rest})")
        .select("a", "b")
        .distinct()
    )


def _posts(scratch: Scratch, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each document and signature that another document has too, with the middle of the signature's list and the
    number of documents in it: the signatures of each set, once."""
    known = rows.where("n > 0 and doc_id is not null")
    nodes = known.join(sets.select("h1", "h2", F.col("node").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    # the middle of a list: fewest tokens below the frequent class, then the least id
    middle = F.min(F.struct(F.expr(f"{_N.format('meta')} - {_F.format('meta')}").alias("r"), "doc_id", "meta"))
    # lists of rarer tokens are short, or will be; of frequent pairs, partial minima are made before the shuffle
    w = W.partitionBy("sig")
    rare = nodes.select("doc_id", "meta", F.explode("rare").alias("sig"), F.lit(False).alias("often"))
    rare = rare.withColumn("p", middle.over(w)).withColumn("x", F.min("doc_id").over(w)).withColumn("y", F.max("doc_id").over(w)).withColumn("docs", F.count("*").over(w)).where("x <> y")
    often = nodes.select("doc_id", "meta", F.explode("often").alias("sig"), F.lit(True).alias("often"))
    lists = scratch.keep(often.groupBy("sig").agg(middle.alias("p"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("docs")).where("x <> y"))
    cols = ["sig", "often", "doc_id", "meta", F.col("p.doc_id").alias("pivot"), F.col("p.meta").alias("pm"), "docs"]
    often = spread_join(often, lists, ["sig"], "sig", hot_counts(lists, "sig", "docs"), F.col("doc_id"))
    out = scratch.keep(rare.select(*cols).union(often.select(*cols)))
    scratch.drop(lists)
    return out


def _settled(scratch: Scratch, docs: DataFrame, rows: DataFrame, sets: DataFrame, index, heavy: int) -> tuple[DataFrame, DataFrame]:
    """rows and posts in which no document indexes by itself a token that more than ``heavy`` documents did."""
    all_heavy = learned = None
    while True:
        posts = _posts(scratch, rows, sets)
        single = posts.where("not often")
        now = single.where(F.col("docs") > heavy).select("sig").distinct()
        new = now if all_heavy is None else now.union(all_heavy).distinct()
        if all_heavy is None and now.isEmpty():
            return rows, posts
        all_heavy = scratch.keep(new)
        found = single.join(all_heavy, "sig", "left_semi").groupBy("doc_id").agg(F.collect_set("sig").alias("known"))
        # a document that indexes one only because no list of two is left with it would not be seen above
        lone = rows.where("n > 0 and doc_id is not null").select("doc_id", F.explode("rare").alias("sig")).join(all_heavy, "sig", "left_semi")
        found = found.union(lone.groupBy("doc_id").agg(F.collect_set("sig")))
        if learned is not None:
            found = found.union(learned)
        before = 0 if learned is None else learned.agg(F.sum(F.size("known"))).first()[0]
        learned = scratch.keep(found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("known")))
        if learned.agg(F.sum(F.size("known"))).first()[0] == before:
            return rows, posts
        again = only_keys(docs, "doc_id", learned, "doc_id").join(learned, "doc_id").select("doc_id", "text", "known").mapInArrow(index, ROW)
        changed = rows.join(learned, "doc_id", "left_anti").unionByName(again)
        old, rows = rows, scratch.keep(changed)
        scratch.drop(old, posts)


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, cell_bits: int = CELL_BITS, heavy: int = HEAVY) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the least doc_id that links reach), n_set_rows.

    docs needs doc_id and text; other columns are not read, whatever their names. Null and empty texts, and texts of white
    space, have no shingles and link with nothing, not even each other. Repeated rows stay rows; rows of one doc_id are one
    node. A null doc_id keeps its row, with a null component_id. An empty table gives an empty result.
    n_set_rows: number of rows with just this set (1 for a set of no shingles). cell_bits and heavy set the cost only.
    """
    if percent < 67:
        raise ValueError("the index is complete for similarities of 67 percent or more")
    with small_batches(docs.sparkSession):
        return _join(docs, k, percent, cell_bits, heavy)


def _join(docs: DataFrame, k: int, percent: int, cell_bits: int, heavy: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark, "ngram-join")
    bits = spark.sparkContext.broadcast(cell_classes(docs, "text", k, cell_bits))
    index = _index(k, percent, cell_bits, bits)
    rows = scratch.keep(docs.mapInArrow(index, ROW))
    sets = scratch.keep(rows.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_set_rows")))
    rows, posts = _settled(scratch, docs, rows, sets, index, heavy)
    stars = posts.where("doc_id <> pivot").where(_near("meta", "pm", percent, "often"))
    least = F.expr("doc_id < pivot")
    stars = stars.select(*[F.when(least if first else ~least, F.col(one)).otherwise(F.col(other)).alias(name) for name, one, other, first in (("a", "doc_id", "pivot", True), ("ma", "meta", "pm", True), ("b", "doc_id", "pivot", False), ("mb", "meta", "pm", False))], F.when(F.col("often"), 0).otherwise(1).alias("w"))
    # a star sees some of what two documents share, so half of what they have to share is asked for; the rest is for later
    stars = scratch.keep(_possible(stars, percent, 0.5))
    links = scratch.keep(_links(stars, docs, k, percent))
    label = scratch.keep(components(scratch, links, "a", "b"))
    # lists whose documents are not all in one component yet
    about = rows.where("n > 0 and doc_id is not null").select("doc_id", "meta", "s1", "s2", "s3", "par").distinct().join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    about = about.withColumn("label", F.coalesce("label", "doc_id"))
    short = _in_short_lists(posts.where("not often").join(about.select("doc_id", "meta", "label").distinct(), ["doc_id", "meta"]), percent)
    left = posts.where("often").join(about, ["doc_id", "meta"]).select("sig", "doc_id", "meta", "s1", "s2", "s3", "par", "label")
    open_ = scratch.keep(left.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("docs")).where("x <> y").select("sig", "docs"))
    more = _in_long_lists(left, open_, percent).union(short.select("a", "ma", "b", "mb", "w"))
    more = scratch.keep(_possible(more, percent, 1.0).join(stars, ["a", "b"], "left_anti"))
    again = scratch.keep(_links(more, docs, k, percent))
    label = scratch.keep(components(scratch, links.union(again), "a", "b"))
    found = scratch.keep(sets.join(label.withColumnRenamed("id", "node"), "node", "left"))
    out = spread_join(rows.select("doc_id", "n", "h1", "h2"), found, ["h1", "h2", "n"], "h1", hot_counts(found, "h1", "n_set_rows"), F.coalesce(F.col("doc_id"), F.lit(0)), "left")
    known = F.col("doc_id").isNotNull()
    out = scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("label", "node", "doc_id")).alias("component_id"), F.when(known & F.col("n_set_rows").isNotNull(), F.col("n_set_rows")).otherwise(1).alias("n_set_rows")))
    scratch.drop(rows, sets, posts, stars, links, open_, more, again, label, found)
    bits.unpersist()
    return out


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SETS = r"""
words AS (SELECT doc_id, regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
toks AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM toks x JOIN toks y ON x.t = y.t AND x.doc_id < y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach(id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT e.y, r.c FROM reach r
  JOIN (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs) e ON r.id = e.x AND r.c < e.y)
"""

SQL = (
    "WITH RECURSIVE "
    + _SETS.format(text="coalesce(text, '')", docs="documents")
    + """SELECT s.doc_id, len(s.s) AS n_shingles, r.c AS component_id,
  CASE WHEN len(s.s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY list_sort(s.s)) END AS n_set_rows
FROM sets s JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) r ON r.id = s.doc_id"""
)
