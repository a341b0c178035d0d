"""Operator 9: benchmark decontamination with an FM-index for each training shard.

Method. All words of a shard of documents (some of one task's rows, of bounded size) become symbols by the shard's own
dictionary, with a terminator behind every document. Over this text the suffix array, the Burrows-Wheeler transform and a
wavelet tree of it are built; the windows of the benchmark are looked up in the dictionary, those of which the shard has all
words are searched backwards at once through wavelet ranks; their occurrences are located by stepping to sampled suffix
positions; word spans of one document are merged for removal. The index knows nothing of the benchmark: ``index_shards``
writes it as a table, and ``search_shards`` searches that for any benchmark. ``fm_decontaminate`` builds each shard's index
and searches it at once, which costs no disk.

Scale. No shuffle and nothing gathered: a shard's index lives in its task, and a lost one is made again. The benchmark is
broadcast in compressed blocks of at most BLOCK_BYTES of text each; a task has one block unpacked at a time. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import io
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from . import _kernels as K

SHARD_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 8  # every so many-th position of the text is kept


class Wavelet:
    """A wavelet tree, level by level: ranks of symbols in prefixes of a text."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (text >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(text) - self.ones[-1][-1]))
            text = np.concatenate([text[bit == 0], text[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the text before each place."""
        start = np.zeros_like(at)
        for j in range(self.levels):
            bit = (symbol >> (self.levels - 1 - j)) & 1
            ones = self.ones[j]
            at = np.where(bit == 1, self.zeros[j] + ones[at], at - ones[at])
            start = np.where(bit == 1, self.zeros[j] + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it is before it."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for j in range(self.levels):
            ones = self.ones[j]
            bit = ones[at + 1] - ones[at]
            at = np.where(bit == 1, self.zeros[j] + ones[at], at - ones[at])
            start = np.where(bit == 1, self.zeros[j] + ones[start], start - ones[start])
            symbol = symbol * 2 + bit
        return symbol, at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling, in which only suffixes that are not yet told apart are sorted again. Every 0 is a terminator that
    differs from, and is less than, all symbols and later terminators; the last symbol has to be one."""
    ends = text == 0
    first = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(first, kind="stable")
    key, slots = first[order], np.arange(len(text))
    rank, step = np.empty(len(text), np.int64), 1
    while True:
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        alone = head & np.concatenate([head[1:], [True]])
        slots = slots[~alone]
        if not len(slots):
            return order
        # none of these has a terminator among its first symbols, so there is text behind them
        at = order[slots]
        key = rank[at] * len(text) + rank[at + step]
        by = np.argsort(key, kind="stable")
        order[slots], key, step = at[by], key[by], 2 * step


class FMIndex:
    """Of a text of symbols from 1 on, in which each 0 ends a segment; the last symbol has to be 0."""

    def __init__(self, last: np.ndarray, kept: np.ndarray, positions: np.ndarray, symbols: int):
        """The transform, which of its rows have a sampled position, these positions, and the number of symbols."""
        self.last, self.sampled, self.positions, self.n = last, kept, positions, len(last)
        self.tree = Wavelet(last.astype(np.int64), symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=symbols))])
        self.kept = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> FMIndex:
        order = suffix_array(text)
        last = np.where(order > 0, text[order - 1], 0)
        # rows whose position is kept: every SAMPLE-th position, and those behind a terminator
        kept = (order % SAMPLE == 0) | (last == 0)
        return cls(last.astype(np.int32), kept, order[kept].astype(np.int32), symbols)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with each pattern. Patterns are right-aligned; a column in front of one is not read."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for j in range(width):
            on = np.flatnonzero((j < lengths) & (low < high))
            if not len(on):
                break
            c = patterns[on, width - 1 - j]
            low[on] = self.less[c] + self.tree.rank(c, low[on])
            high[on] = self.less[c] + self.tree.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, live, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            done = self.kept[rows + 1] > self.kept[rows]
            out[live[done]] = self.positions[self.kept[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            symbol, before = self.tree.access(rows)
            rows, steps = self.less[symbol] + before, steps + 1
        return out


class Windows:
    """The distinct windows of a block of items, as places in the block's sorted distinct words, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        raws = [(t or "").encode() for _, t in items]
        data = K.LOWER[np.frombuffer(b"".join(raws), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64)
        starts, ends, item = K.split_words(data, offsets, K.NOT_ALNUM)
        hashes = K.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.words, symbol = np.unique(hashes, return_inverse=True)
        count = np.bincount(item, minlength=len(items))
        begin = np.cumsum(count) - count
        # first word and length of every window: whole short items, and runs of ``size`` words within the others
        short = np.flatnonzero((count > 0) & (count < size))
        at = np.arange(len(symbol))
        at = at[at + size <= (begin + count)[item]]
        first, length = np.concatenate([begin[short], at]), np.concatenate([count[short], np.full(len(at), size)])
        patterns = np.full((len(first), size), -1, np.int64)
        for j in range(size):  # right-aligned
            on = length > j
            patterns[on, size - 1 - j] = symbol[first[on] + length[on] - 1 - j]
        self.patterns, window = np.unique(patterns, axis=0, return_inverse=True) if len(first) else (patterns, np.zeros(0, np.int64))
        self.lengths = (self.patterns >= 0).sum(1)
        names, of = np.unique(np.array([n for n, _ in items], object).astype(str), return_inverse=True)
        pairs = np.unique(np.stack([window.ravel(), of[item[first]]], 1), axis=0)
        self.names, self.item = names, pairs[:, 1]
        self.begin = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))


class Shard:
    """The index of some documents: dictionary, document and place (in code points) of every word, and the FM-index."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, index: FMIndex | None):
        self.words, self.doc, self.starts, self.ends, self.n, self.index = words, doc, starts, ends, n, index

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Shard:
        n, low = len(offsets) - 1, K.LOWER[data]
        starts, ends, doc = K.split_words(low, offsets, K.NOT_ALNUM)
        words, symbol = np.unique(K.word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64), return_inverse=True)
        text = np.zeros(len(symbol) + n, np.int64)  # a terminator behind each document
        text[np.arange(len(symbol)) + doc] = symbol + 1
        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        base = point[offsets[:-1]][doc]
        return cls(words, doc, point[starts] - base, point[ends] - base, n, FMIndex.of(text, len(words) + 1) if n else None)

    def occurrences(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(word, window) of every occurrence."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.words) or not len(windows.patterns):
            return none
        spot = np.minimum(np.searchsorted(self.words, windows.words), len(self.words) - 1)
        symbol = np.append(np.where(self.words[spot] == windows.words, spot + 1, 0), 1)  # the last one stands for no word
        patterns = symbol[windows.patterns]
        may = np.flatnonzero((patterns > 0).all(1))
        if not len(may):
            return none
        low, high = self.index.search(patterns[may], windows.lengths[may])
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        at = self.index.locate(rows)
        # places in the text have a terminator for each document before
        begins = np.searchsorted(self.doc, np.arange(self.n)) + np.arange(self.n)
        return at - (np.searchsorted(begins, at, side="right") - 1), may[which]

    def report(self, blocks) -> list[pa.Array]:
        """For each document: words, hit words, sorted ids of the items found, merged spans in code points."""
        cover, names = np.zeros(len(self.doc) + 1, np.int64), [set() for _ in range(self.n)]
        for windows in blocks():
            at, which = self.occurrences(windows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.lengths[which], -1)
            for d, w in np.unique(np.stack([self.doc[at], which], 1), axis=0).tolist():
                names[d].update(windows.names[windows.item[windows.begin[w] : windows.begin[w + 1]]].tolist())
        hit = np.cumsum(cover[:-1]) > 0
        same = np.concatenate([[False], self.doc[1:] == self.doc[:-1]])
        on = hit & ~(np.concatenate([[False], hit[:-1]]) & same)[: len(hit)]
        off = hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([same[1:], [False]]))[: len(hit)]
        spans: list[list[dict]] = [[] for _ in range(self.n)]
        for s, e, d in zip(self.starts[on].tolist(), self.ends[off].tolist(), self.doc[on].tolist(), strict=True):
            spans[d].append({"start": s, "end": e})
        return [pa.array(np.bincount(self.doc, minlength=self.n)), pa.array(np.bincount(self.doc[hit], minlength=self.n)), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(spans, SPANS)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        fm = self.index
        np.savez(out, words=self.words, doc=self.doc.astype(np.int32), starts=self.starts, size=(self.ends - self.starts).astype(np.int32), n=self.n, last=fm.last, kept=np.packbits(fm.sampled), positions=fm.positions)
        return zstandard.ZstdCompressor(level=1).compress(out.getvalue())

    @classmethod
    def from_bytes(cls, body: bytes) -> Shard:
        x = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body)))
        index = FMIndex(x["last"], np.unpackbits(x["kept"])[: len(x["last"])].astype(bool), x["positions"].astype(np.int64), len(x["words"]) + 1)
        return cls(x["words"], x["doc"].astype(np.int64), x["starts"], x["starts"] + x["size"], int(x["n"]), index)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
NEW = ["n_words", "n_hit", "items", "spans"]


def _opened(blocks: list):
    """A function that goes through the blocks, one unpacked at a time; a single one is unpacked once."""
    load = lambda b: pickle.loads(zstandard.ZstdDecompressor().decompress(b.value))
    only = [load(blocks[0])] if len(blocks) == 1 else None
    return lambda: only or map(load, blocks)


def _search(blocks: list):
    def run(batches):
        opened = _opened(blocks)
        for batch in batches:
            # a carried text is in the row, and is not sent twice
            text = batch.column(1) if batch.num_columns > 1 else batch.column(0).field("text")
            for a, b, data, offsets in K.slices(text, SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *Shard.of(data, offsets).report(opened)], ["row", *NEW])

    return K.tidy(run)


def index_shards(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the index of docs to a table at path, which all executors read, and returns that: a row for each shard, with
    the ids of its documents and the index. The table serves any benchmark."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1), SHARD_BYTES):
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([ids, pa.array([Shard.of(data, offsets).to_bytes()], pa.binary())], ["ids", "body"])

    docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(K.tidy(run), "ids array<long>, body binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def search_shards(index: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans, as of ``fm_decontaminate``, from a table of ``index_shards``."""
    blocks = benchmark_blocks(benchmark, size, block_bytes)

    def run(batches):
        opened = _opened(blocks)
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)[i].as_py(), pa.int64()), *Shard.from_bytes(batch.column(1)[i].as_py()).report(opened)], ["doc_id", *NEW])

    return index.select("ids", "body").mapInArrow(K.tidy(run), f"doc_id long, {FOUND}")


def benchmark_blocks(benchmark: DataFrame, size: int, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the packed windows of the items, in blocks of at most so many bytes of text (or one item)."""
    sc = benchmark.sparkSession.sparkContext
    out, block, used = [], [], 0

    def send():
        out.append(sc.broadcast(zstandard.ZstdCompressor(level=3).compress(pickle.dumps(Windows(block, size)))))

    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if row[0] is None:
            continue
        more = len((row[1] or "").encode())
        if block and used + more > block_bytes:
            send()
            block, used = [], 0
        block.append((row[0], row[1]))
        used += more
    send()
    return out


def fm_decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns ``carry`` of docs and n_words, n_hit, items (ids of the items with an occurring window, sorted as
    strings), spans (merged runs of hit words, in code points of the text, end exclusive): a row for each row of docs.

    Null, empty and wordless texts have no words and no hits; items without words have no window, and items without an id,
    which could not be named, are no items. Repeated rows are kept; items of one id are one item. Other columns are not read;
    carried ones that have the new columns' names are replaced. An empty benchmark hits nothing; an empty docs table gives an
    empty result.
    """
    blocks = benchmark_blocks(benchmark, size, block_bytes)
    names = [c for c in carry if c not in NEW]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    inside = "text" in names and docs.schema["text"].dataType == StringType()
    rows = docs.select(row) if inside else docs.select(row, F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_search(blocks), StructType([rows.schema["row"], *StructType.fromDDL(FOUND).fields]))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *NEW)


def without_spans(found: DataFrame) -> DataFrame:
    """The same rows, with the spans cut out of the text. Built-in functions only."""
    n = F.size("spans")
    begin = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("spans", i - 1)["end"]))
    end = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == n, F.char_length("text").cast("long")).otherwise(F.get("spans", i)["start"]))
    cut = F.array_join(F.zip_with(begin, end, lambda b, e: F.substring(F.col("text"), (b + 1).cast("int"), (e - b).cast("int"))), "")
    return found.withColumn("text", F.when(n == 0, F.col("text")).otherwise(cut))


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontaminate(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")), carry=("doc_id",))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
sizes AS (SELECT DISTINCT n FROM wins),
hits AS (SELECT p.r, p.i, x.n, x.item FROM (SELECT r, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS k FROM pos, sizes s WHERE i + s.n - 1 <= len(w)) p
  JOIN wins x ON x.n = p.n AND x.k = p.k),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""
