"""Operator 10: BPE encoding and decoding, speculated and verified.

Method. Texts are normalised and cut into words as the tokenizer's file says. For each distinct word, greedy longest match
proposes tokens. A row of tokens is the encoding if and only if every token is its own encoding and every two neighbours
stay apart when their bytes are encoded together; that is tested for all neighbours of all new words at once, by walking
the merges that made both sides back. Only words that fail are merged exactly, by rank. Decoding joins token strings.

Letters, numbers and lower case are those of the library's own Unicode tables: the driver asks it once about every code
point, and texts with a code point from the first doubtful one on are cut by a pattern that spells the differences out.

The model's tables come from the file, on the driver, and are broadcast: their size is that of the vocabulary. A task keeps
the words that it has seen, up to a fixed number, and starts anew beyond it, so memory is bounded. There is no shuffle.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K

KEPT_WORDS = 120_000
LONG_WORD = 300  # bytes
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _ranges(points: set[int]) -> str:
    """A class body for a pattern, of code points."""
    out, ordered = [], sorted(points)
    for i, c in enumerate(ordered):
        if i and ordered[i - 1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Tables:
    """Where the library's Unicode tables differ from those of this Python: asked about every code point, on the driver."""

    def __init__(self, words: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        split = pre_tokenizers.Split(Regex(words), "removed", invert=True)
        pieces = lambda text: [x for x, _ in split.pre_tokenize_str(text)]
        change: dict[str, set[int]] = {k: set() for k in "LNSO"}
        to: dict[str, set[int]] = {k: set() for k in "LNSO"}
        self.lower: dict[int, str] = {}
        patterns = [("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", regex.compile(f"[{_SPACE}]"))]
        for begin in range(0, 0x110000, 4096):  # a few thousand at a time
            points = [c for c in range(begin, begin + 4096) if not 0xD800 <= c < 0xE000]
            if not points:
                continue
            mine = [next((k for k, p in patterns if p.match(chr(c))), "O") for c in points]
            # runs of one class are asked about at once, and one by one where the answer differs
            for kind, run in groupby(zip(mine, points), key=lambda x: x[0]):
                run = [c for _, c in run]
                text = "".join(map(chr, run))
                if kind in "LO" and pieces(text) == [text] and (kind == "O") == (len(pieces("!" + text)) == 1):
                    continue
                for c in run:
                    x = chr(c)
                    found = "S" if not pieces(x) else "L" if len(pieces("a" + x)) == 1 else "O" if len(pieces("!" + x)) == 1 else "N"
                    if found != kind:
                        change[kind].add(c)
                        to[found].add(c)
            rest = [c for c in points if c != 1]
            low = normalizers.Lowercase().normalize_str("\x01".join(map(chr, rest))).split("\x01")
            self.lower |= {c: x for c, x in zip(rest, low, strict=True) if x != chr(c).lower() and chr(c) != "Σ"}
        doubtful = {*self.lower, *chain.from_iterable(to.values())}
        self.first_byte = chr(min(doubtful)).encode()[0] if doubtful else 256
        for k, base in (("L", r"\p{L}"), ("N", r"\p{N}")):
            less, more = _ranges(change[k]), _ranges(to[k])
            words = words.replace(f"[{base}]", f"[@{base}" + (f"--[{less}]" if less else "") + (f"||[{more}]" if more else "") + "]")
        spaces = f"[{_SPACE}{_ranges(to['S'])}]"
        spaces = f"[{spaces}--[{_ranges(change['S'])}]]" if change["S"] else spaces
        classes = {k: regex.search(r"\[@(.*?\]?)\](?=\+?\||\|)", words[words.index("[@" + base) :]).group(1) for k, base in (("L", r"\p{L}"), ("N", r"\p{N}"))}
        words = words.replace("[@", "[")
        self.words = "(?V1)" + words.replace(r"[^\s\p{L}\p{N}]", f"(?:(?!{spaces}|[{classes['L']}]|[{classes['N']}])(?s:.))")


class Model:
    """Tables of a tokenizers file of the kind: NFC, lower case, words, byte letters, BPE with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe, kinds = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or bpe["end_of_word_suffix"] != END or bpe["ignore_merges"] or bpe["dropout"]:
            raise ValueError("not a tokenizer of the kind that this operator encodes for")
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = words.replace(r"\s", _SPACE)
        self.tables = Tables(words)
        ids: dict[str, int] = bpe["vocab"]
        self.n = 1 + max([*ids.values(), *self.specials.values()])
        self.strings = [""] * self.n
        for text, i in [*ids.items(), *self.specials.items()]:
            self.strings[i] = text
        letters = byte_letters()
        self.first = np.array([ids[x] for x in letters], np.int32)
        self.last = np.array([ids[x + END] for x in letters], np.int32)
        self.halves = np.stack([np.arange(self.n), np.arange(self.n)]).astype(np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        rank = np.full(self.n, -1, np.int64)
        for r, m in enumerate(bpe["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = ids[a + b]
            if (ids[a], ids[b]) not in self.merges:
                self.merges[ids[a], ids[b]] = (r, whole)
            if rank[whole] < 0:
                rank[whole], self.halves[0][whole], self.halves[1][whole] = r, ids[a], ids[b]
        self.rank = rank
        keys = sorted(self.merges)
        self.pair_keys = np.array([a * self.n + b for a, b in keys], np.int64)
        self.pair_ranks = np.array([self.merges[x][0] for x in keys], np.int64)
        #: tokens that are their own encoding, by bytes: inside a word, and at its end
        byte = {x: bytes([b]) for b, x in enumerate(letters)}
        self.inside: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for text, i in ids.items():
            end = text.endswith(END) and text != END
            raw = b"".join(byte[x] for x in (text[: -len(END)] if end else text))
            if self.merged(raw, end) == [i]:
                (self.final if end else self.inside)[raw] = i
        #: by its first three bytes, how long a token can be
        self.reach: dict[bytes, int] = {}
        for raw in [*self.inside, *self.final]:
            self.reach[raw[:3]] = max(self.reach.get(raw[:3], 2), len(raw))

    def merged(self, raw: bytes, end: bool = True) -> list[int]:
        """Exact merging: the adjacent pair of least rank first, leftmost of equals."""
        out = [int(self.first[b]) for b in raw]
        if end and out:
            out[-1] = int(self.last[raw[-1]])
        if len(out) > LONG_WORD:
            return self._merged_long(out)
        get, none = self.merges.get, (1 << 60, 0)
        found = [get(p, none) for p in zip(out, out[1:])]
        ranks = [x[0] for x in found]
        while ranks and (best := min(ranks)) < 1 << 60:
            i = ranks.index(best)
            out[i : i + 2] = [found[i][1]]
            del ranks[i], found[i]
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    found[j] = get((out[j], out[j + 1]), none)
                    ranks[j] = found[j][0]
        return out

    def _merged_long(self, out: list[int]) -> list[int]:
        """The same with a heap of pairs and links to neighbours, for words of any length."""
        n = len(out)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(out, out[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if out[i] != a or j < 0 or out[j] != b:
                continue
            out[i], out[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (out[k], out[after[k]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], k, *p))
        return [t for t in out if t >= 0]

    def greedy(self, raw: bytes) -> list[int]:
        out, i, n = [], 0, len(raw)
        inside, final, reach = self.inside, self.final, self.reach
        while i < n:
            end = min(n, i + reach.get(raw[i : i + 3], 2))
            while True:
                piece = raw[i:end]
                t = final.get(piece) if end == n else inside.get(piece)
                if t is not None:
                    out.append(t)
                    i = end
                    break
                end -= 1
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does encoding their joined bytes give just these two?

        Both sides are unmade, the later made one first. Where the two that touch would have merged before the side that was
        unmade last was made, the pair fails.
        """
        ok = np.zeros(len(left), bool)
        live, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        limit, strict = np.full(len(left), 1 << 60), np.zeros(len(left), bool)  # strict: a merge of the same rank came first
        while len(live):
            at = np.minimum(np.searchsorted(self.pair_keys, a * self.n + b), len(self.pair_keys) - 1)
            r = np.where(self.pair_keys[at] == a * self.n + b, self.pair_ranks[at], 1 << 60)
            fails = (r < limit) | ((r == limit) & strict)
            done = ~fails & (self.rank[a] < 0) & (self.rank[b] < 0)
            ok[live[done]] = True
            on = ~(fails | done)
            live, a, b = live[on], a[on], b[on]
            open_left = self.rank[a] > self.rank[b]
            # the left side's last merge is unmade; a merge of the same rank that starts further right comes after it
            limit = np.where(open_left, self.rank[a], self.rank[b])
            strict = ~open_left
            a, b = np.where(open_left, self.halves[1][a], a), np.where(open_left, b, self.halves[0][b])
        return ok

    def encode_words(self, raws: list[bytes]) -> list[list[int]]:
        proposed = [self.greedy(x) for x in raws]
        sizes = np.array([len(x) for x in proposed])
        flat = np.fromiter((t for x in proposed for t in x), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(raws)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) > 1 else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        fails = ~self.apart(pairs // self.n, pairs % self.n)[back]
        for i in np.unique(word[inner[fails]]):
            proposed[i] = self.merged(raws[i])
        return proposed


class _Coder:
    def __init__(self, model: Model):
        self.model = model
        self.find = regex.compile(model.words).findall
        self.find_exactly = regex.compile(model.tables.words).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, model.specials)) + ")") if model.specials else None
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {x: i for i, x in enumerate(self.model.specials)}
        self.flat = np.array(list(self.model.specials.values()), np.int32)
        self.ends = np.arange(1, len(self.flat) + 1)

    def _words(self, text: str, doubtful: bool) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if doubtful:
            return self.find_exactly(text.translate(self.model.tables.lower).lower())
        return self.find(text.lower())

    def cut(self, text: str, doubtful: bool = True) -> list[str]:
        if self.special is None or not any(x in text for x in self.model.specials):
            return self._words(text, doubtful)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._words(part, doubtful)
        return out

    def encode(self, texts: list[str | None], doubtful: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's begin and end. doubtful: may a text have a code point about which
        the library's tables and this Python's differ?"""
        words = [self.cut(x or "", d) for x, d in zip(texts, doubtful, strict=True)]
        seen = set(chain.from_iterable(words)) - self.index.keys()
        if len(self.index) + len(seen) > KEPT_WORDS:
            self.clear()
            seen = set(chain.from_iterable(words)) - self.index.keys()
        if seen:
            new = sorted(seen)
            coded = self.model.encode_words([x.encode() for x in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            sizes = np.array([len(x) for x in coded])
            self.flat = np.concatenate([self.flat, np.fromiter((t for x in coded for t in x), np.int32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1:].sum() + np.cumsum(sizes)])
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        begins = np.concatenate([[0], self.ends[:-1]])
        sizes = (self.ends - begins)[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(begins[which] - total[:-1], sizes)]
        return ids, total[np.concatenate([[0], np.cumsum([len(x) for x in words])])]


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) for every row: what the tokenizers library gives for the file at
    path with add_special_tokens=False, and for its decode with skip_special_tokens=False.

    A null text counts as empty; an empty one, or one of white space, has no ids and decodes to an empty text. Strings of
    special tokens in a text become these tokens. Repeated rows and null keys are kept; other columns are not read. An empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_of(path))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        coder = _Coder(model.value)
        strings = pa.array(model.value.strings)
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                late = np.concatenate([[0], np.cumsum(data >= coder.model.tables.first_byte)])
                ids, at = coder.encode(batch.column(1).slice(a, b - a).to_pylist(), (late[offsets[1:]] > late[offsets[:-1]]).tolist())
                at, ids = pa.array(at, pa.int32()), pa.array(ids, pa.int32())
                decoded = pc.binary_join(pa.ListArray.from_arrays(at, strings.take(ids)), " ")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(at, ids), decoded], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(K.tidy(run), "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))
