"""Token ids of slices of texts for the tokenizer that operator 10 encodes for, by array passes over all characters at once.

Texts whose code points all lie below 0x250, keep their form in NFC and have a lower case there are cut by tables of classes
and lower case, which are asked of operator 10's exact patterns. All other texts, and those with a ``<|``, go through operator
10's coder. Either way the ids are those of the tokenizers library.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from ..functions.merging import MergeTable, merge_words
from .bpe_verify import KEPT_WORDS, LONG_WORD, Model, _Coder

TOP = 0x250
SPACE, LETTER, DIGIT, OTHER = range(4)
#: What the tokenizer's pattern takes off a word behind a lone apostrophe.
SHORT = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


class SliceCoder:
    """Encodes slices of a text column. Words that were seen are kept, up to a fixed number."""

    def __init__(self, model: Model):
        self.model, self.slow = model, _Coder(model)
        self.low, self.kind, self.plain = np.arange(TOP, dtype=np.uint16), np.zeros(TOP, np.uint8), np.zeros(TOP, bool)
        for c in range(TOP):
            x = chr(c).translate(model.tables.lower).lower()
            if len(x) == 1 and ord(x) < TOP and unicodedata.is_normalized("NFC", chr(c)):
                self.plain[c], self.low[c], self.kind[c] = True, ord(x), self._class(x)
        self.second = np.zeros(TOP, np.uint8)  # the letter behind an apostrophe that ends the cut, 1 if it is cut at once
        for x, y in SHORT.items():
            self.second[ord(x)] = ord(y) if y else 1
        merges = np.array([(a, b, whole) for (a, b), (_, whole) in model.merges.items()], np.int64)  # by rank
        self.table = MergeTable(*merges.T, model.n)
        self.clear()

    def _class(self, x: str) -> int:
        pieces = self.slow.find_exactly
        if not pieces(x):
            return SPACE
        return LETTER if len(pieces("a" + x)) == 1 else OTHER if len(pieces("!" + x)) == 1 else DIGIT

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _known(self, words: np.ndarray) -> np.ndarray:
        """The numbers of distinct words, new ones learned first."""
        get, n = self.index.get, len(words)
        which = np.fromiter((get(x, -1) for x in words), np.int64, n)
        new = np.flatnonzero(which < 0)
        if len(self.index) + len(new) > KEPT_WORDS:
            self.clear()
            new = np.arange(n)
        if len(new):
            flat, sizes = self.merged([x.encode() for x in words[new]])
            which[new] = np.arange(len(self.index), len(self.index) + len(new))
            self.index.update(zip(words[new].tolist(), which[new].tolist(), strict=True))
            self.ends = np.concatenate([self.ends, self.ends[-1:].sum() + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
        return which

    def merged(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: token ids of all, and how many each has. Very long words go one by one."""
        m = self.model
        size = np.array([len(x) for x in raws])
        body = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum(size)
        token = m.first[body].astype(np.int64)
        token[ends - 1] = m.last[body[ends - 1]]
        word = np.repeat(np.arange(len(raws)), size)
        long = np.flatnonzero(size > LONG_WORD)
        if not len(long):
            ids, word = merge_words(token, word, self.table)
        else:
            short = ~(size > LONG_WORD)[word]
            ids, word = merge_words(token[short], word[short], self.table)
            late = [np.array(m.merged(raws[i]), np.int64) for i in long]
            word = np.concatenate([word, np.repeat(long, [len(x) for x in late])])
            order = np.argsort(word, kind="stable")
            ids, word = np.concatenate([ids, *late])[order], word[order]
        return ids.astype(np.int32), np.bincount(word, minlength=len(raws))

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All words of plain texts, and the number of words up to each text's begin and end."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[at]
        points = first.astype(np.uint16)
        two = np.flatnonzero(first >= 0xC0)
        points[two] = ((points[two] & 0x1F) << 6) | (data[at[two] + 1] & 0x3F)
        rows = np.searchsorted(at, offsets)
        kind, low = self.kind[points], self.low[points]
        start = np.ones(len(kind), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start[rows[rows < len(kind)]] = True
        bare = np.flatnonzero(low == ord("'"))
        if len(bare):
            fresh = np.append(start, True)
            bare = bare[fresh[bare] & fresh[bare + 1] & (bare + 1 < len(kind))]
            end = np.searchsorted(rows, bare, "right")
            end = np.where(end < len(rows), rows[np.minimum(end, len(rows) - 1)], len(kind))  # where the text ends
            bare, end = bare[(bare + 1 < end) & (kind[np.minimum(bare + 1, len(kind) - 1)] == LETTER)], end[(bare + 1 < end) & (kind[np.minimum(bare + 1, len(kind) - 1)] == LETTER)]
            more = self.second[low[bare + 1]]
            after = np.where(bare + 2 < end, low[np.minimum(bare + 2, len(low) - 1)], 0)
            cut = np.where(more == 1, 2, np.where((more > 1) & (after == more), 3, 0))
            bare, end, cut = bare[cut > 0], end[cut > 0], cut[cut > 0]
            start[bare + 1] = False
            start[(bare + cut)[bare + cut < end]] = True
        start &= kind != SPACE
        counts = np.concatenate([[0], np.cumsum(start)])[rows]
        kept = kind != SPACE
        low = low[kept]
        begins = np.flatnonzero(start[kept])
        wide = low >= 0x80
        place = np.concatenate([[0], np.cumsum(1 + wide)])
        body = np.empty(place[-1], np.uint8)
        body[place[:-1]] = np.where(wide, 0xC0 | (low >> 6), low)
        body[place[:-1][wide] + 1] = 0x80 | (low[wide] & 0x3F)
        bounds = np.append(place[begins], place[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(body)), counts

    def encode(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a slice of texts, and where each text's begin and end. data, offsets: the slice's UTF-8 bytes, which
        are fewer than 2 ** 31; a null counts as empty."""
        odd = data >= 0xCA
        lead = np.flatnonzero((data >= 0xC2) & ~odd)
        odd[lead] = ~self.plain[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        before = np.concatenate([[0], np.cumsum(odd)])
        slow = np.flatnonzero(before[offsets[1:]] > before[offsets[:-1]])
        if len(slow):
            keep = np.ones(len(data), bool)
            for i in slow:
                keep[offsets[i] : offsets[i + 1]] = False
            sizes = np.diff(offsets)
            sizes[slow] = 0
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(sizes)])
        words, counts = self._words(data, offsets)
        coded = words.dictionary_encode()
        which = self._known(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
        begins = np.concatenate([[0], self.ends[:-1]])[: len(self.ends)]
        sizes = (self.ends - begins)[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(begins[which] - total[:-1], sizes)]
        at = total[counts]
        if not len(slow):
            return ids, at
        late, where = self.slow.encode(column.take(pa.array(slow)).to_pylist(), [True] * len(slow))
        parts, sizes, last = [], np.diff(at), 0
        for k, i in enumerate(slow):
            parts += [ids[at[last] : at[i]], late[where[k] : where[k + 1]]]
            sizes[i], last = where[k + 1] - where[k], i
        return np.concatenate([*parts, ids[at[last] :]]), np.concatenate([[0], np.cumsum(sizes)])
