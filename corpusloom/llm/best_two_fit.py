"""Operator 11: packing documents into sequences of a fixed length by best-two-fit.

Method. A sequence is filled greedily, with the longest unpacked piece that fits, again and again. If a gap is left, the
shortest piece in it goes back, and the two unpacked pieces that fit the widened gap most tightly take its place, if they
leave less of it. Pieces of one length are alike, so the filling is planned on the number of pieces of each length, and a
filling is repeated for as long as each of its choices would be made again. The plan thus has a bounded size, whatever the
number of documents: at most one count for each length goes to the driver, and the plan is broadcast.

Each piece then finds its place by its length and its rank among the pieces of that length. Ranks are numbered within each task
that encodes, in the written table; a table of counts by (length, task) gives the number before each, so no task gathers a
length. The only shuffle is of these small rows, and a length that many pieces have is dealt out by task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _kernels as K
from ._coder import SliceCoder
from ._scratch import Scratch
from .bpe_verify import model_of, tokenizer_path

MAX_TOKENS = 2048
END_ID = 0
RANKS = 1 << 44  # more pieces than that of one length are not expected

Filling = tuple[int, dict[int, int]]


def _greedy(live: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often each, the longest that fits first."""
    used: dict[int, int] = {}
    at = bisect_right(live, room) - 1
    while at >= 0 and room:
        times = min(counts[live[at]], room // live[at])
        used[live[at]] = times
        room -= times * live[at]
        at = min(at, bisect_right(live, room)) - 1
    return used


def _two(live: np.ndarray, free: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths with free pieces whose sum is the largest up to room, if it is more than ``more_than``; of equal
    sums, the one with the longest piece."""
    live, free = live[free > 0], free[free > 0]
    if not len(live):
        return None
    best = np.searchsorted(live, room - live, "right") - 1  # the longest partner
    best = np.minimum(best, np.arange(len(live)))
    best = np.where((best == np.arange(len(live))) & (free < 2), best - 1, best)
    total = np.where(best >= 0, live + live[best], 0)
    i = len(live) - 1 - int(np.argmax(total[::-1]))
    return (int(live[i]), int(live[best[i]])) if total[i] > more_than else None


def plan(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Fillings (how many sequences, how many pieces of each length) that use up all pieces, by best-two-fit."""
    counts = {k: n for k, n in counts.items() if n > 0}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("pieces have one token at least and fit a sequence")
    live, out = sorted(counts), []
    while live:
        tried = _greedy(live, counts, capacity)
        filling, gap = dict(tried), capacity - sum(k * n for k, n in tried.items())
        if gap:
            least = min(tried)
            lengths = np.array(live)
            free = np.array([counts[k] - tried.get(k, 0) for k in live])
            if pair := _two(lengths, free, gap + least, least):
                filling[least] -= 1
                for k in pair:
                    filling[k] = filling.get(k, 0) + 1
                    tried[k] = tried.get(k, 0) + 1
        filling = {k: n for k, n in filling.items() if n}
        # each choice is made again while what was tried is there
        times = min((counts[k] - n) // filling[k] + 1 for k, n in tried.items() if k in filling)
        out.append((times, filling))
        for k, n in filling.items():
            counts[k] -= times * n
        live = [k for k in live if counts[k]]
    return out


def places(fillings: list[Filling]) -> np.ndarray:
    """A row for each filling and length in it, by (length, first rank): key, first sequence, pieces a sequence, offset of the
    first of them, length."""
    rows, rank, base = [], {}, 0
    for times, filling in fillings:
        offset = 0
        for length in sorted(filling, reverse=True):
            n = filling[length]
            rows.append((length * RANKS + rank.get(length, 0), base, n, offset, length))
            rank[length] = rank.get(length, 0) + times * n
            offset += n * length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def pieces_of(docs: DataFrame, path: str, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the token ids of every document with an END_ID behind, cut only where they
    exceed the capacity; and task and rank_in_task, which number the pieces of one length. Write it before use."""
    model = docs.sparkSession.sparkContext.broadcast(model_of(path))
    schema = pa.schema([*_PIECES, ("task", pa.int32()), ("rank_in_task", pa.int64())])

    def run(batches):
        coder, task = SliceCoder(model.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1), 1 << 20):
                ids, at = coder.encode(batch.column(1).slice(a, b - a), data, offsets)
                ids = np.insert(ids, at[1:], END_ID).astype("<u4")
                at = at + np.arange(len(at))
                sizes = np.diff(at)
                cuts = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                begin = at[row] + start
                crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(begin.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order], "left")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - first + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                ids_of = batch.column(0).slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank)],
                    schema=schema,
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        K.tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"
    )


def best_two_fit(docs: DataFrame, path: str, capacity: int = MAX_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32, sequence_id (gapless from 0), offset (gapless in each sequence), a row
    for each piece of every document.

    A document is the tokenizers library's ids for the file at path (add_special_tokens=False) and END_ID behind them. Only
    longer ones than the capacity are cut, into pieces of the capacity and a last one. A null or empty text is END_ID alone.
    Repeated rows and null keys are packed each on its own. Pieces of one length are told apart by task and place only, so
    which of them goes where is not defined. Other columns are not read. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("a sequence has one token at least")
    spark = docs.sparkSession
    rows = Scratch(spark, "op11").keep(pieces_of(docs, path, capacity, text, key))
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    # one count for each length, so as many as the capacity at most
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(lengths, capacity)))
    before = counts.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = rows.join(before, ["length", "task"]).select(*[c for c, _ in _PIECES], (F.col("rank_in_task") + F.col("before")).alias("rank"))
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        keys, base, times, offset, _ = table.value.T
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * RANKS + rank, "right") - 1
            nth = rank - keys[at] % RANKS
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base[at] + nth // times[at]), pa.array(offset[at] + nth % times[at] * length)], schema=schema)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
