"""Tables of counts of fixed size, summed over tasks as compressed blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._kernels import tidy

BLOCK = 1 << 14
SCHEMA = "block int, counts binary"


def packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Counts as compressed bytes, one for a cell where they fit and else eight."""
    pack = zstandard.ZstdCompressor(level=1)
    body = [pack.compress(x.astype("u1" if x.max() < 256 else "<i8").tobytes()) for x in blocks.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(body, pa.binary())], ["block", "counts"])


def unpacked(body: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    return np.frombuffer(raw, "u1" if len(raw) == BLOCK else "<i8").astype(np.int64)


def _sum(batches):
    have: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            have[b] = have.get(b, 0) + unpacked(body)
    yield packed(have)


def count_table(df: DataFrame, cells: int, of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each cell comes in what ``of`` gives for the batches of df: exact counts over all rows.

    Each task sends one table; a block's tables are summed as a stream; the driver gets one table. ``cells``: a multiple of
    BLOCK.
    """

    def run(batches):
        counts = np.zeros(cells, np.int32)
        for batch in batches:
            for found in of(batch):
                np.add.at(counts, found, 1)
        blocks = counts.reshape(-1, BLOCK)
        for i in range(0, len(blocks), 64):
            yield packed({b: blocks[b] for b in range(i, min(i + 64, len(blocks))) if blocks[b].any()})

    out = np.zeros((cells // BLOCK, BLOCK), np.int64)
    for row in df.mapInArrow(tidy(run), SCHEMA).repartition(24, "block").mapInArrow(tidy(_sum), SCHEMA).collect():
        out[row.block] = unpacked(row.counts)
    return out.ravel()
