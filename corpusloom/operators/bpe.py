"""Byte-pair vocabularies: training on a word table, artifacts, encoding and decoding of frames.

Spark counts words (one shuffle of each task's distinct words). The order of merges is sequential by nature: it is found on the
driver over distinct words, as one flat array of two bytes a token, that is scanned for each merge; counts of pairs are kept
for pairs that are there only. Encoding merges the distinct pretokens of a batch all at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.merging import MergeTable, merge_words
from ..functions.text import special_pretokens
from .rules import canonical_json

KEPT_WORDS, SLICE = 100_000, 1 << 18  # words that a task keeps, and pretokens or ids that it takes at once
SHIFT, LOW = 32, (1 << 32) - 1  # a pair as one number: left id, right id
PART = 1 << 16  # words that array passes take at once
COMPACT = 64  # merges after which slots are closed up


class _Corpus:
    """Distinct words as token ids in one flat array, each in a slot of its own; behind a word its slot is filled with a number
    that is no token, at least one, so that no pair reaches over two words."""

    def __init__(self, data: np.ndarray, size: np.ndarray, counts: np.ndarray, most_ids: int):
        kind = np.uint16 if most_ids < 1 << 16 else np.uint32
        self.end = np.iinfo(kind).max
        self.size = size.astype(np.int32)
        self.counts = counts.astype(np.int64 if len(counts) and counts.max() >= 1 << 31 else np.int32)
        self.tokens = np.full(len(data) + len(size), self.end, kind)
        for part in _parts(np.arange(len(size))):
            a, b = (int(self.size[:n].sum(dtype=np.int64)) for n in (part[0], part[-1] + 1)) if len(part) else (0, 0)
            self.tokens[a + part[0] + np.arange(b - a) + np.repeat(np.arange(len(part)), self.size[part])] = data[a:b]
        place = np.int32 if len(self.tokens) < 1 << 31 else np.int64
        self.begin = np.cumsum(self.size + 1, dtype=place) - self.size - 1

    def gathered(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of some words, and each one's word."""
        size = self.size[words]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.tokens[np.repeat(self.begin[words], size) + place].astype(np.int64), np.repeat(words, size)

    def sums(self, tokens: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of some words and how often they come, a word that has one counting with all its occurrences in the corpus."""
        inner = word[1:] == word[:-1]
        key, word = ((tokens[:-1] << SHIFT) | tokens[1:])[inner], word[1:][inner]
        order = np.lexsort((word, key))
        key, word = key[order], word[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (word[1:] != word[:-1])
        return _summed(key[new], self.counts[word[new]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        found = [self.sums(*self.gathered(words)) for words in _parts(np.arange(len(self.size)))]
        return _summed(*map(np.concatenate, zip(*found, strict=True))) if found else _NOTHING

    def merge(self, key: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """Makes a merge in all words that have it; gives the pairs whose counts change, and by how much."""
        at = np.flatnonzero(self.tokens == key >> SHIFT)  # never the last place
        at = at[self.tokens[at + 1] == key & LOW]
        words = np.searchsorted(self.begin, at, "right") - 1
        found = [x for part in _parts(words[np.append(True, words[1:] != words[:-1])] if len(words) else words) for x in self.merged(part, key, whole)]
        key_, change = _summed(*map(np.concatenate, zip(*found, strict=True))) if found else _NOTHING
        return key_[change != 0], change[change != 0]

    def merged(self, words: np.ndarray, key: int, whole: int) -> list[tuple[np.ndarray, np.ndarray]]:
        tokens, word = self.gathered(words)
        gone = self.sums(tokens, word)
        hit = np.flatnonzero((((tokens[:-1] << SHIFT) | tokens[1:]) == key) & (word[1:] == word[:-1]))
        if key >> SHIFT == key & LOW:  # of a run of one token every second pair
            run = np.append(True, hit[1:] != hit[:-1] + 1)
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
        tokens[hit] = whole
        stay = np.ones(len(tokens), bool)
        stay[hit + 1] = False
        tokens, word = tokens[stay], word[stay]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        old, size = self.size[words], np.diff(np.append(first, len(word)))
        place = lambda n, start: np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.tokens[place(old, self.begin[words])] = self.end
        self.tokens[place(size, self.begin[words])] = tokens
        self.size[words] = size
        return [(gone[0], -gone[1]), self.sums(tokens, word)]

    def compact(self) -> None:
        """Leaves out words of one token, which have no pairs, and what is free in slots."""
        words = np.flatnonzero(self.size > 1)
        kept = [self.gathered(part)[0].astype(self.tokens.dtype) for part in _parts(words)]
        size = self.size[words]
        self.__init__(np.concatenate(kept) if kept else self.tokens[:0], size, self.counts[words], self.end - 1)


_NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in the order of keys."""
    if not len(key):
        return _NOTHING
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first, dtype=np.int64)


def _parts(words: np.ndarray) -> list[np.ndarray]:
    return [words[i : i + PART] for i in range(0, len(words), PART)]


def _learned(corpus: _Corpus, n_merges: int) -> list[tuple[bytes, bytes]]:
    strings = [bytes([b]) for b in range(256)]
    ids = {x: i for i, x in enumerate(strings)}
    pair = lambda k: (strings[k >> SHIFT], strings[k & LOW])
    keys, counts = corpus.pairs()
    merges: list[tuple[bytes, bytes]] = []
    while len(merges) < n_merges and len(keys):
        best = max(keys[counts == counts.max()].tolist(), key=pair)
        merges.append(pair(best))
        text = b"".join(pair(best))
        if text not in ids:
            ids[text] = len(strings)
            strings.append(text)
        key, change = corpus.merge(best, ids[text])
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[at] == key
        counts[at[there]] += change[there]
        at = np.searchsorted(keys, key[~there])
        stay = np.insert(counts > 0, at, True)
        keys, counts = np.insert(keys, at, key[~there])[stay], np.insert(counts, at, change[~there])[stay]
        if len(merges) % COMPACT == 0:
            corpus.compact()
    return merges


def learn_merges(words: dict[bytes, int], vocab_size: int, n_specials: int = 0) -> list[tuple[bytes, bytes]]:
    """Merges in order. A pair counts once for each distinct word that has it, times the word's count; of equal counts the
    greatest pair in byte order is merged first."""
    if vocab_size < 256 + n_specials:
        raise ValueError("a vocabulary has all bytes and all special tokens")
    size = np.array([len(w) for w in words], np.int64)
    corpus = _Corpus(np.frombuffer(b"".join(words), np.uint8), size, np.array(list(words.values()), np.int64), vocab_size)
    return _learned(corpus, vocab_size - 256 - n_specials)


class Tokenizer:
    """A vocabulary: special tokens first, then bytes, then merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]], specials: list[str] | None = None):
        self.specials = list(specials or [])
        if len(set(self.specials)) < len(self.specials):
            raise ValueError("special tokens have to differ")
        self.merges = merges
        tokens = [*(s.encode() for s in self.specials), *(bytes([b]) for b in range(256))]
        seen = set(tokens[len(self.specials) :])
        for a, b in merges:
            if a + b not in seen:
                seen.add(a + b)
                tokens.append(a + b)
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens) if i >= len(self.specials)}
        sides = np.array([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.table = MergeTable(*sides.T, len(tokens))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of many words, merged together; a special token is its own."""
        special = {x: i for i, x in enumerate(self.specials)}
        raws = [b"" if w in special else w.encode() for w in words]
        word = np.repeat(np.arange(len(words)), [len(x) for x in raws])
        token = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64) + len(self.specials)
        ids, word = merge_words(token, word, self.table)
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        flat = ids.tolist()
        return [[special[w]] if w in special else flat[a:b] for w, a, b in zip(words, bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def encode_word(self, word: str) -> list[int]:
        return self.encode_words([word])[0]

    def decode(self, ids) -> str:
        if any(not 0 <= i < len(self.tokens) for i in ids):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")

    def body(self) -> dict:
        return {"merges": [[a.hex(), b.hex()] for a, b in self.merges], "specials": self.specials, "version": 1}

    def save(self, path: str) -> str:
        """Writes the artifact with the digest of its canonical form; gives the digest."""
        body = self.body()
        digest = hashlib.sha256(canonical_json(body).encode()).hexdigest()
        with open(path, "x", encoding="utf-8") as f:
            json.dump(body | {"sha256": digest}, f)
        return digest

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
        digest = body.pop("sha256", None)
        if hashlib.sha256(canonical_json(body).encode()).hexdigest() != digest:
            raise ValueError("the artifact's digest is not that of its contents")
        return cls([(bytes.fromhex(a), bytes.fromhex(b)) for a, b in body["merges"]], body["specials"])


def train(docs: DataFrame, vocab_size: int, specials: list[str] | None = None, text: str = "text") -> Tokenizer:
    """Learns a vocabulary of the column ``text``. The driver gets each distinct pretoken and its count, in columns, and makes no
    object of a word: it holds two bytes for each byte and some 14 for each word."""
    specials = list(specials or [])
    if vocab_size < 256 + len(specials):
        raise ValueError("a vocabulary has all bytes and all special tokens")
    words = docs.select(F.explode(special_pretokens(F.col(text), specials, keep=False)).alias("tok")).groupBy("tok").count()
    parts = [_columns(batch) for batch in words.where("tok is not null").toArrow().to_batches()]
    data, size, counts = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate((np.uint8, np.int32, np.int64)))
    del parts
    corpus = _Corpus(data, size, counts, vocab_size)
    del data, size, counts
    return Tokenizer(_learned(corpus, vocab_size - 256 - len(specials)), specials)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sizes and counts of a batch of words."""
    words = batch.column(0).cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds).astype(np.int32), batch.column(1).to_numpy()


def encode(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids. Pretokens are made on the JVM; a task merges the distinct ones of SLICE pretokens at once, and keeps up to
    KEPT_WORDS of them. Pretokens stay Arrow columns, so no object is made of one but where it is new. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("array<int>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(model.value)
        for rows in batches:
            parts = [known.coded(rows.slice(a, b - a)) for a, b in _slices(rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.select(key, code(special_pretokens(F.col(text), tokenizer.specials)).alias("ids"))


def _slices(rows: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Bounds of slices of rows with SLICE items at most, or of one row."""
    ends = np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield a, b
        a = b


class _Known:
    """The words that a task has met, by number, and their ids in one flat array."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def coded(self, rows: pa.ListArray) -> pa.ListArray:
        words = rows.flatten().dictionary_encode()
        seen = words.dictionary.to_pylist()
        new = [w for w in seen if w not in self.number]
        if len(self.number) + len(new) > KEPT_WORDS:
            self.clear()
            new = seen
        coded = self.tokenizer.encode_words(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in coded], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.int32)])
        word = np.array([self.number[w] for w in seen], np.int64)[words.indices.to_numpy()] if seen else np.zeros(0, np.int64)
        size = self.begin[word + 1] - self.begin[word]
        ends = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(self.begin[word] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = np.append(0, np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(ids), mask=rows.is_null())


def decode(coded: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text; bytes that are no UTF-8 become replacement characters."""
    model = coded.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("string")
    def back(rows: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else model.value.decode(x) for x in rows.slice(a, b - a).to_pylist()], pa.string()) for a, b in _slices(rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return coded.select(key, back(ids).alias("text"))
