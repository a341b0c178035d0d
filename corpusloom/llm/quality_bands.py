"""Operator 3: quality rules by compression bands.

Method. The zstandard ratio (compressed / raw bytes) of the whole text, and of fixed chunks of it, has to lie in a band
that depends on the length: below it text is repetitive, above it incompressible. Short texts carry the frame's fixed cost
and have wider bands. The upper limits lie between clean text and random letters and digits (six bits a character, as in
base64), which can be told apart from about 128 bytes on. A text is rejected if its own ratio is out of its band, or those
of chunks that make up more than a quarter of its bytes; the last, shorter chunk has the band of its own length. Word counts and repeated windows are counted on word hashes, per slice of documents. No shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K

LEVEL = 3
CHUNK = 4096
#: (from so many bytes, least ratio, greatest ratio)
BANDS = ((0, 0.0, 99.0), (64, 0.45, 1.30), (128, 0.40, 0.94), (192, 0.40, 0.88), (256, 0.36, 0.83), (384, 0.36, 0.79), (512, 0.32, 0.75), (768, 0.32, 0.72), (1024, 0.28, 0.70), (2048, 0.28, 0.68), (4096, 0.25, 0.67), (16384, 0.22, 0.66))
BAD_CHUNKS = 0.25

SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True
FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"), ("bad_chunks", "double")]


def _in_band(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, bool]:
    ratio = len(pack.compress(raw)) / len(raw)
    _, least, most = next(b for b in reversed(BANDS) if len(raw) >= b[0])
    return ratio, least <= ratio <= most


def verdict(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole (0 for an empty one), share of bytes in chunks out of their band, and whether both are in bounds.

    Texts shorter than a chunk have none.
    """
    if not raw:
        return 0.0, 0.0, True
    ratio, fine = _in_band(raw, pack)
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) >= CHUNK else []
    bad = sum(len(x) for x in chunks if not _in_band(x, pack)[1]) / len(raw)
    return ratio, bad, fine and bad <= BAD_CHUNKS


def _repeat_words(doc: np.ndarray, hashes: np.ndarray, n: int, k: int = 8) -> np.ndarray:
    """Per document: words in windows of k words that the document has twice or more."""
    found, first = K.window_hashes(hashes, doc, k)
    out = np.zeros(n, np.int64)
    if not len(found):
        return out
    order = np.lexsort((found, doc[first]))
    f, d = found[order], doc[first][order]
    same = (f[1:] == f[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(f), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = first[order][twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _measure(batches):
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for a, b, data, offsets in K.slices(batch.column(1)):
            n = b - a
            starts, ends, doc = K.split_words(data, offsets, K.SPACE)
            words = np.bincount(doc, minlength=n)
            head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            chars = np.bincount(doc, weights=head[ends] - head[starts], minlength=n).astype(np.int64)
            marks = np.concatenate([[0], np.cumsum(SYMBOL[data])])
            symbols = marks[offsets[1:]] - marks[offsets[:-1]]
            repeat = _repeat_words(doc, K.word_hashes(data, starts, ends), n)
            raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(n)]
            lines = np.array([_dup_lines(x) for x in raw], np.int64)
            failed = (words < 20) | (100 * repeat > 30 * words)
            ratio, bad, fine = (np.array(x) for x in zip(*(verdict(x, pack) for x in raw), strict=True))
            cols = [words.astype(np.int64), chars, symbols.astype(np.int64), lines, repeat.astype(np.int64), failed, ~failed & fine, ratio, bad]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), *map(pa.array, cols)], ["doc_id", *(x for x, _ in FIELDS)])


def quality_bands(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the counts, verdicts and ratios of FIELDS, a row for each row.

    Null, empty and white-space texts have no words: base_failed, not kept. Texts of under 64 bytes have no band. Repeated
    rows and null keys are kept as they are; other columns are not read. An empty table gives an empty result.
    """
    schema = "doc_id long, " + ", ".join(f"{n} {t}" for n, t in FIELDS)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(K.tidy(_measure), schema)


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))
