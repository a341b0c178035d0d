"""Vectorised text kernels shared by the Arrow-batched operators.

They work on the UTF-8 bytes of a slice of documents at once, so that Python cost is a few array passes per slice and
not a loop per word. Slices are bounded in bytes (a single longer document is a slice of its own), which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64

#: Words of operators 1 and 3: everything but ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of operator 9: ASCII letters and digits, and every byte of a character beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    NOT_ALNUM[_a:_b] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _powers = 0x9E3779B97F4A7C15 | 1, {}


def give_back() -> None:
    """Returns freed memory to the system. A worker lives on after its task, and would hold the most that it ever used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable) -> Callable:
    """The same function over Arrow batches, which leaves no memory behind in its worker."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            give_back()

    return tidied


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U64(salt)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most ``limit`` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, body = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def split_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes outside ``gap`` in one document), and each word's document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~gap[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
        back = _power(pow(_BASE, -1, 1 << 64), n + 1)
        return mix((total[ends] - total[starts]) * back[starts], 1)


def window_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words of one document, and the index of each window's first word."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        total = words[:n] * _MULT[0]
        for j in range(1, k):
            total += words[j : j + n] * _MULT[j]
        inside = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return mix(total[inside], k), inside


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of n documents begins in an array sorted by document, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of k lower-cased words; a shorter one's words are one shingle."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, doc = split_words(data, offsets, SPACE)
    words = word_hashes(data, starts, ends)
    found, first = window_hashes(words, doc, k)
    at, by = bounds(doc[first], n), bounds(doc, n)
    out = []
    for i in range(n):
        m = by[i + 1] - by[i]
        if m >= k:
            out.append(np.unique(found[at[i] : at[i + 1]]))
        elif m:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(words[by[i] : by[i + 1]] * _MULT[:m]).sum(dtype=np.uint64)], np.uint64), 1000 + int(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
