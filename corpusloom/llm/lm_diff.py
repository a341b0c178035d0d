"""Operator 6: language-model scoring by cross-entropy difference.

Method. Two word bigram models, of a target text collection and of the background (the documents themselves), share one
vocabulary: every word of both, told apart by 64-bit hashes, a boundary in front of a text, and a symbol for words that
neither has. Each is smoothed towards its unigrams, p(w|h) = (s c(h,w) + PRIOR p(w)) / (s c(h) + PRIOR). The models are
matched: one vocabulary, order and smoothing, and as much evidence, since the counts of the larger collection are scaled (s)
to the number of tokens of the smaller one. All rows are counted; none is drawn or left out to that end. A document that is
itself part of the background is scored without its own pairs, so both models judge text that they have not seen; a second
copy of it elsewhere counts. Unigrams are those of the whole collections. A document's score is the mean over its tokens of
target loss minus background loss (nats): the lower, the more it is like the target.

Scale. All words and pairs of all documents are counted, and none is folded into another: what is gathered grows with the
input. Words are counted with one shuffle of a task's distinct words. The counts of KNOWN words at most and, for pairs of the
SYMBOLS - 1 most frequent words, two tables of 2048 x 2048 counts (16 MB each) are broadcast. Everything else goes to
buckets, packed, with one shuffle: first counts of distinct pairs by slice, then each document's pairs, which are answered
slice by slice with sums by document. So a task holds the distinct pairs of one bucket. There is a bucket for PER_BUCKET
tokens; pairs of words so frequent that one pair might fill several buckets are dealt out over SPREAD of them, which all get
its count. Words beyond the known ones have a KNOWN-th of all tokens each at most; pairs with such a word go to the bucket of
that word, which so learns the word's own count too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._scratch import Scratch
from ._tables import count_table

SYMBOLS = 2048
KNOWN = 1 << 19  # words whose counts are broadcast
PRIOR = 50.0
PER_BUCKET = 4_000_000  # tokens
SPREAD = 64
SLICE = 1 << 20
BITS = 20  # of a word's place
BOUNDARY = K.U64(0x6C6D5F646966662E)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of what is in front of it, and its document; the first of a document follows the boundary."""
    low = K.LOWER[data]
    starts, ends, doc = K.split_words(low, offsets, K.NOT_ALNUM)
    words = K.word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    before = np.full(len(words), BOUNDARY)
    before[1:] = np.where(doc[1:] == doc[:-1], words[:-1], BOUNDARY)
    return before, words, doc


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(before * K._MULT[0] + words * K._MULT[1], 2).view(np.int64)


def _count_words(batches):
    """word, n (how often it comes), heads (how often something follows it)."""
    keys, counts, waiting = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), []

    def settle():
        nonlocal keys, counts
        all_ = np.concatenate([keys, *(k for k, _ in waiting)])
        n = np.concatenate([counts, *(c for _, c in waiting)])
        keys, back = np.unique(all_, return_inverse=True)
        counts = np.stack([np.bincount(back, weights=n[:, j], minlength=len(keys)).astype(np.int64) for j in (0, 1)], 1)
        waiting.clear()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(counts[:, j])) for j in (0, 1))], ["word", "n", "heads"])

    for batch in batches:
        for _, _, data, offsets in K.slices(batch.column(0)):
            before, words, _ = _tokens(data, offsets)
            found, n = np.unique(words, return_counts=True)
            waiting.append((found, np.stack([n, n], 1)))
            first = np.flatnonzero(before == BOUNDARY)
            if len(first):  # nothing follows the last word of a document
                last = np.append(words[first[1:] - 1], words[-1:])
                none = np.zeros(len(first), np.int64)
                waiting.append((last, np.stack([none, none - 1], 1)))
                waiting.append((np.array([BOUNDARY]), np.array([[0, len(first)]])))
            if len(waiting) >= 48:
                settle()
                if len(keys) > 1_000_000:  # bounds memory; the sums are made behind the shuffle
                    yield out()
                    keys, counts = keys[:0], counts[:0]
    settle()
    yield out()


class Places:
    """Places of 64-bit hashes in a sorted array, by open addressing: a few array passes for any number of questions."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, max(4, int(4 * len(words) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(words)), self._home(words)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # one of those with the same slot gets it
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> K.U64(64 - self.bits)).astype(np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or the number of words if it is none of them."""
        out, at, live = np.full(len(hashes), len(self.words)), self._home(hashes), np.arange(len(hashes))
        while len(live):
            found = self.slots[at]
            used = found >= 0
            live, at, found = live[used], at[used], found[used]
            same = self.words[found] == hashes[live]
            out[live[same]] = found[same]
            live, at = live[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out


class Vocabulary:
    """Counts of the known words, the place of the most frequent ones in the tables, and the tables."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: np.ndarray, symbols: int, own: bool):
        """words: hashes; counts: a row (n, heads of the target, n, heads of the background) for each. own: are the scored
        documents the background?"""
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        self.places, self.unknown, self.own = Places(words), len(words), float(own)
        both = totals.min() if totals.min() > 0 else totals.max()
        self.scale = np.minimum(1.0, both / np.maximum(totals, 1))
        self.floor = PRIOR / (self.scale * totals + symbols)  # PRIOR p(w) of a word with no count
        self.prior = self.floor * (self.scale * counts[:, [0, 2]] + 1.0)
        self.heads = counts[:, [1, 3]].astype(float)
        self.n = counts[:, 0] + counts[:, 2]
        n = np.where(words == BOUNDARY, -1, self.n)
        top = np.lexsort((words, -n))[: SYMBOLS - 1]
        top = top[n[top] >= 0]
        self.symbol = np.full(self.unknown + 1, -1, np.int64)  # the last one is for unknown words
        self.symbol[top] = np.arange(len(top))
        self.symbol[:-1][words == BOUNDARY] = SYMBOLS - 1
        self.boundary = int(np.searchsorted(words, BOUNDARY))
        self.tables: list[np.ndarray] = []

    def look(self, data: np.ndarray, offsets: np.ndarray):
        """Hashes of what is in front and of the word, their places, and the document, for each token."""
        before, words, doc = _tokens(data, offsets)
        at = self.places.of(words)
        front = np.full(len(at), self.boundary)
        front[1:] = np.where(before[1:] == BOUNDARY, self.boundary, at[:-1])
        return before, words, front, at, doc

    def cells(self, f: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place in the tables for each pair, -1 if it has none."""
        a, b = self.symbol[f], self.symbol[w]
        return np.where((a >= 0) & (b >= 0), a * SYMBOLS + b, -1)

    def terms(self, prior: np.ndarray, m: np.ndarray, counts, own: float | None = None) -> list[np.ndarray]:
        """Logarithms of smoothed counts, as often as they come in the document (m). prior: a column for each model."""
        both = counts[0], np.maximum(counts[1] - (self.own if own is None else own) * m, 0)
        return [m * np.log(self.scale[j] * c + prior[:, j]) for j, c in enumerate(both)]

    def wide(self, f: np.ndarray, w: np.ndarray, per_bucket: int) -> np.ndarray:
        """May one pair of these words fill several buckets?"""
        return np.minimum(self.n[f], self.n[w]) > 8 * per_bucket


def vocabulary(words: DataFrame, known: int = KNOWN, own: bool = True) -> tuple[Vocabulary, np.ndarray]:
    """The known words, and the tokens of target and background."""
    nt, nb, n = words.agg(F.sum("nt"), F.sum("nb"), F.count("*")).first()
    totals, symbols = np.array([nt or 0, nb or 0]), max(SYMBOLS, n)
    least, taken = 1 << 62, 0
    for r in words.groupBy((F.col("nt") + F.col("nb")).alias("n")).count().orderBy(F.desc("n")).toLocalIterator():
        taken += r["count"]
        if taken > known:
            break
        least = r.n
    rows = words.where((F.col("nt") + F.col("nb") >= least) | (F.col("word") == int(BOUNDARY))).toArrow()
    counts = np.stack([rows[c].to_numpy() for c in ("nt", "ht", "nb", "hb")], 1).astype(np.int64)
    return Vocabulary(rows["word"].to_numpy().astype(np.int64).view(np.uint64), counts, totals, symbols, own), totals


def _pack(pack: zstandard.ZstdCompressor, first: np.ndarray, *rest: np.ndarray) -> bytes:
    """A column of 64-bit numbers, as differences, and columns of 32-bit ones; byte by byte, which compresses better."""
    wide = np.diff(first.view(np.uint64), prepend=np.uint64(0)).astype("<u8")
    return pack.compress(b"".join(np.ascontiguousarray(x.view("u1").reshape(len(first), -1).T).tobytes() for x in (wide, *(r.astype("<u4") for r in rest))))


def _unpack(body: bytes, rest: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "u1").reshape(8 + 4 * rest, -1)
    out = [np.ascontiguousarray(raw[8 + 4 * i : 12 + 4 * i].T).view("<u4").ravel().astype(np.int64) for i in range(rest)]
    with np.errstate(over="ignore"):
        return [np.cumsum(np.ascontiguousarray(raw[:8].T).view("<u8").ravel(), dtype=np.uint64), *out]


def _runs(bucket: np.ndarray):
    """(bucket, begin, end) of equal values in a sorted array."""
    edge = np.flatnonzero(np.diff(bucket)) + 1
    yield from ((int(bucket[a]), a, b) for a, b in zip([0, *edge], [*edge, len(bucket)], strict=True) if b > a)


#: Kinds of rows in a bucket. Counts of known pairs come first; then documents' sums that need no counts, their known pairs,
#: and their pairs with an unknown word, unknown words in front of a known one, and unknown words in front of any.
COUNTS, SUMS, PAIRS, LATE, EARLY, FRONTS = range(6)
ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("side", pa.int8()), ("docs", pa.binary()), ("body", pa.binary())])
ROW_SQL = "bucket int, kind byte, side byte, docs binary, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(ROW)], schema=ROW)


def _spot(key: np.ndarray, count: int) -> np.ndarray:
    return (K.mix(key.astype(np.uint64), 5) % K.U64(count)).astype(np.int64)


def _send(model, count: int, per_bucket: int, side: int, scored: bool, counted: bool):
    """What buckets need of a collection. Columns: key, doc_id, text. side: 0 target, 1 background; scored: are its documents
    scored? counted: do they belong to the model of ``side``?"""

    def run(batches):
        v: Vocabulary = model.value
        pack, spread = zstandard.ZstdCompressor(level=1), min(SPREAD, count)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, b, data, offsets in K.slices(batch.column(2), SLICE):
                rows: list[tuple] = []
                mine = keys[a:b]
                before, found, front, at, doc = v.look(data, offsets)
                if not scored:
                    doc = np.zeros_like(doc)

                def send(kind: int, bucket: np.ndarray, d: np.ndarray, *columns: np.ndarray):
                    """Rows of a kind: columns sorted by the first one within a bucket, and local numbers of the documents."""
                    order = np.lexsort((columns[0], bucket))
                    for to, x, y in _runs(bucket[order]):
                        on = order[x:y]
                        there, local = np.unique(d[on], return_inverse=True)
                        rows.append((to, kind, side, mine[there].astype("<i8").tobytes() if scored else b"", _pack(pack, *(c[on] for c in columns), local)))

                # known pairs; key: document, word in front, word
                on = (front < v.unknown) & (at < v.unknown)
                key, m = np.unique(doc[on] << 2 * BITS | front[on] << BITS | at[on], return_counts=True)
                pair, d = key & ((1 << 2 * BITS) - 1), key >> 2 * BITS
                f, w = pair >> BITS, pair & ((1 << BITS) - 1)
                cell = v.cells(f, w)
                if scored:
                    inner = cell >= 0
                    sums = v.terms(v.prior[w[inner]], m[inner], [t[cell[inner]].astype(float) for t in v.tables])
                    x, mx = np.unique((doc << BITS | front)[front < v.unknown], return_counts=True)
                    tops = v.terms(np.full((len(x), 2), PRIOR), mx, v.heads[x & ((1 << BITS) - 1)].T)
                    own = np.stack([np.bincount(x >> BITS, weights=tops[j], minlength=b - a) - np.bincount(d[inner], weights=sums[j], minlength=b - a) for j in (0, 1)])
                    ids = batch.column(1).slice(a, b - a)
                    none = np.asarray(ids.is_null())
                    facts = np.stack([np.asarray(ids.fill_null(0)), none.astype(np.int64), np.bincount(doc, minlength=b - a)])
                    rows.append((int(_spot(mine[:1], count)[0]), SUMS, side, mine.astype("<i8").tobytes(), facts.astype("<i8").tobytes() + own.astype("<f8").tobytes()))
                outer = cell < 0
                pair, d, m, f, w = pair[outer], d[outer], m[outer], f[outer], w[outer]
                wide = v.wide(f, w, per_bucket)
                base = _spot(pair, count)
                if counted:
                    distinct, first, back = np.unique(pair, return_index=True, return_inverse=True)
                    n = np.bincount(back, weights=m, minlength=len(distinct)).astype(np.int64)
                    copies = np.where(wide[first], spread, 1)
                    which = np.repeat(np.arange(len(distinct)), copies)
                    inner = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
                    bucket = (base[first][which] + inner) % count
                    order = np.lexsort((which, bucket))
                    for to, x, y in _runs(bucket[order]):
                        on = which[order[x:y]]
                        rows.append((to, COUNTS, side, b"", _pack(pack, distinct[on], n[on])))
                if scored:
                    send(PAIRS, (base + np.where(wide, mine[d] % spread, 0)) % count if len(d) else base, d, pair, m)
                # pairs with an unknown word, which are few: what they are counted by, their hash, their document
                late, early = at == v.unknown, (front == v.unknown) & (at < v.unknown)
                for kind, on, by in ((LATE, late, found), (EARLY, early, before), (FRONTS, front == v.unknown, before)):
                    on = np.flatnonzero(on)
                    if not len(on):
                        continue
                    full = by[on] if kind == FRONTS else _pair(before[on], found[on]).view(np.uint64)
                    order = np.lexsort((full, doc[on]))
                    on, full = on[order], full[order]
                    new = np.concatenate([[True], (full[1:] != full[:-1]) | (doc[on][1:] != doc[on][:-1])])
                    m = np.diff(np.append(np.flatnonzero(new), len(on)))
                    on, full = on[new], full[new]
                    # of the word: its hash in two halves, or its place
                    more = [by[on] >> K.U64(32), by[on] & K.U64(0xFFFFFFFF)] if kind == LATE else [at[on]] if kind == EARLY else []
                    send(kind, _spot(by[on], count), doc[on], full, *more, m)
                if rows:
                    yield _batch(rows)

    return K.tidy(run)


class _Counts:
    """Counts of both sides by key, looked up in sorted keys."""

    def __init__(self, waiting: list[tuple[int, np.ndarray, np.ndarray]]):
        self.keys, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, x, _ in waiting)]), return_inverse=True)
        n = np.concatenate([np.zeros(0), *(x for _, _, x in waiting)])
        side = np.concatenate([np.zeros(0), *(np.full(len(x), s) for s, x, _ in waiting)])
        self.n = [np.bincount(back, weights=np.where(side == j, n, 0), minlength=len(self.keys)) for j in (0, 1)]

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys))] * 2
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return [np.where(self.keys[at] == keys, n[at], 0.0) for n in self.n]


def _answer(model, scored_side: int, counted: bool):
    """Sums of terms by document, from rows sorted by bucket and kind. Pairs with an unknown word are held until a bucket's
    end, as their own rows give the counts; of known pairs only the distinct ones are held."""
    names = ["k", "doc_id", "n", "lt", "lb", "copies"]

    def run(batches):
        v: Vocabulary = model.value
        ask = {PAIRS: 2, LATE: 4, EARLY: 3, FRONTS: 2}

        def sums(docs: bytes, d: np.ndarray, terms: list[np.ndarray], sign: float):
            k = np.frombuffer(docs, "<i8")
            none = pa.nulls(len(k), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(k), none, none, *(pa.array(sign * np.bincount(d, weights=x, minlength=len(k))) for x in terms), none], names)

        def end(held: list[tuple]):
            for kind in (LATE, EARLY, FRONTS):
                rows = [(r[1], r[2], _unpack(r[3], ask[kind])) for r in held if r[0] == kind]
                part = [(side, x) for side, _, x in rows if side != scored_side or counted]
                counts = _Counts([(side, x[0], x[-2]) for side, x in part])
                word = lambda x: x[1].astype(np.uint64) << K.U64(32) | x[2].astype(np.uint64)
                words = _Counts([(side, word(x), x[-2]) for side, x in part]) if kind == LATE else None
                for side, docs, x in rows:
                    if not docs:
                        continue
                    if kind == LATE:
                        prior = np.stack([v.floor[j] * (v.scale[j] * n + 1.0) for j, n in enumerate(words.of(word(x)))], 1)
                    else:
                        prior = v.prior[x[1]] if kind == EARLY else np.full((len(x[0]), 2), PRIOR)
                    yield sums(docs, x[-1], v.terms(prior, x[-2], counts.of(x[0])), 1.0 if kind == FRONTS else -1.0)

        bucket, waiting, held, counts = None, [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from end(held)
                    bucket, waiting, held, counts = row["bucket"], [], [], None
                kind, body = row["kind"], row["body"]
                if kind == COUNTS:
                    waiting.append((row["side"], *_unpack(body, 1)))
                elif kind == SUMS:
                    k = np.frombuffer(row["docs"], "<i8")
                    facts, own = np.frombuffer(body, "<i8", 3 * len(k)).reshape(3, -1), np.frombuffer(body, "<f8", offset=24 * len(k)).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(facts[0], mask=facts[1] > 0), pa.array(facts[2]), pa.array(own[0]), pa.array(own[1]), pa.array(np.ones(len(k), np.int64))], names)
                elif kind == PAIRS:
                    counts, waiting = counts or _Counts(waiting), []
                    pair, m, d = _unpack(body, 2)
                    w = (pair & K.U64((1 << BITS) - 1)).astype(np.int64)
                    yield sums(row["docs"], d, v.terms(v.prior[w], m, counts.of(pair)), -1.0)
                else:
                    held.append((kind, row["side"], row["docs"], body))
        yield from end(held)

    return K.tidy(run)


def lm_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, text: str = "text", key: str = "doc_id", known: int = KNOWN, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (mean nats a token), score (their difference) for every row of docs.

    target, background (docs if not given): the collections, with a column ``text``. Null, empty and wordless texts have no
    tokens and null losses, and add nothing to a model; an empty collection gives its model the uniform distribution.
    Repeated rows are kept and count each time, and each is scored without itself; other columns are not read. An empty docs
    table gives an empty result. ``known`` (1 << 19 at most) and ``per_bucket`` bound what is broadcast and what a task
    holds, and set the cost only.
    """
    spark: SparkSession = docs.sparkSession
    own = background is None
    one, two = (d.select(F.col(text).cast("string").alias("text")) for d in (target, docs if own else background))
    none = F.lit(0).cast("long")
    count = lambda d: d.mapInArrow(K.tidy(_count_words), "word long, n long, heads long")
    both = count(one).select("word", F.col("n").alias("nt"), F.col("heads").alias("ht"), none.alias("nb"), none.alias("hb"))
    both = both.union(count(two).select("word", none, none, "n", "heads")).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("nt", "ht", "nb", "hb")])
    scratch = Scratch(spark, "lm-diff")
    words = scratch.keep(both)
    vocab, totals = vocabulary(words, min(known, KNOWN), own)
    scratch.drop(words)
    plain = spark.sparkContext.broadcast(vocab)

    def cells(batch):
        for _, _, data, offsets in K.slices(batch.column(0)):
            _, _, front, at, _ = plain.value.look(data, offsets)
            cell = plain.value.cells(front, at)
            yield cell[cell >= 0]

    tables = [count_table(d, SYMBOLS * SYMBOLS, cells).astype(np.float32) for d in (one, two)]
    plain.unpersist()
    vocab.tables = tables
    model = spark.sparkContext.broadcast(vocab)
    buckets = max(24, -(-int(totals.sum()) // per_bucket))
    body = F.col(text).cast("string")
    rows = docs.select(F.xxhash64(F.col(key).cast("long"), body).alias("k"), F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    bare = lambda d: d.select(none.alias("k"), none.alias("doc_id"), "text")
    sent = rows.mapInArrow(_send(model, buckets, per_bucket, 1, True, own), ROW_SQL)
    sent = sent.union(bare(one).mapInArrow(_send(model, buckets, per_bucket, 0, False, True), ROW_SQL))
    if not own:
        sent = sent.withColumn("side", F.when(F.length("docs") > 0, 2).otherwise(F.col("side")).cast("byte"))
        sent = sent.union(bare(two).mapInArrow(_send(model, buckets, per_bucket, 1, False, True), ROW_SQL))
    parts = sent.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer(model, 1 if own else 2, own), "k long, doc_id long, n long, lt double, lb double, copies long")
    sums = parts.groupBy("k").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n", "lt", "lb", "copies")])
    mean = [F.when(F.col("n") > 0, F.col(c) / F.col("n")).alias(name) for c, name in (("lt", "loss_target"), ("lb", "loss_background"))]
    out = sums.select("doc_id", F.expr("n div copies").alias("n_tokens"), *mean, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_tokens", "loss_target", "loss_background", (F.col("loss_target") - F.col("loss_background")).alias("score"))


def op6_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the conversations; background: all documents."""
    docs, talk = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "conversations"))
    return lm_difference(docs, talk)
