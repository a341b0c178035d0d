"""Packing against a version that fills one sequence at a time, and token ids against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import _kernels as K
from corpusloom.llm import best_two_fit as P
from corpusloom.llm._coder import SliceCoder
from corpusloom.llm.bpe_verify import model_of, tokenizer_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def one_at_a_time(sizes, capacity):
    """Best-two-fit on a list, a sequence at a time, each pair tried."""
    left, out = sorted(sizes, reverse=True), []
    while left:
        bin_, room = [], capacity
        for x in list(left):
            if x <= room:
                bin_.append(x)
                left.remove(x)
                room -= x
        if room:
            least = min(bin_)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= room + least]
            if pairs:
                _, a, b = max(pairs)
                bin_.remove(least)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, least], reverse=True)
                bin_ += [a, b]
        out.append(sorted(bin_, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_that_of_single_fillings(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 50])
    sizes = [min(capacity, rng.choice([rng.randrange(1, capacity + 1), 1 + int(rng.expovariate(6 / capacity)), capacity // 3])) for _ in range(rng.randrange(1, 90))]
    counts = {k: sizes.count(k) for k in set(sizes)}
    got = [sorted((x for x, n in f.items() for _ in range(n)), reverse=True) for times, f in P.plan(counts, capacity) for _ in range(times)]
    assert sorted(got) == sorted(one_at_a_time(sizes, capacity))


def test_plan_size_depends_on_lengths_only():
    rng = np.random.default_rng(1)
    few = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, 257, 20_000), return_counts=True)], strict=True))
    many = {k: n * 100_000 for k, n in few.items()}
    assert len(P.plan(many, 256)) < 2 * 256
    assert sum(t for t, _ in P.plan(many, 256)) <= 1.02 * sum(k * n for k, n in many.items()) / 256
    with pytest.raises(ValueError):
        P.plan({300: 1}, 256)


def test_ids_are_the_library_s(library):
    coder, rng = SliceCoder(model_of(tokenizer_path())), random.Random(4)
    texts = ["".join(rng.choices("abcDstmdrevl'' .\n#5é²ªÀſ", k=rng.randrange(0, 14))) for _ in range(6000)]
    texts += [None, "", " ", "'", "'s", "'ll'", "''s", "'l l", "x<|endoftext|>'D", "日本語 'T", "é" * 700, "a" * 3000, "<|"] * 2
    texts += [f"a{chr(i)}1 !{chr(i)}'{chr(i)}S" for i in range(0x250)]
    column = pa.array(texts, pa.string())
    for a, b, data, offsets in K.slices(column, 4000):
        ids, at = coder.encode(column.slice(a, b - a), data, offsets)
        for i in range(a, b):
            assert ids[at[i - a] : at[i - a + 1]].tolist() == library.encode(texts[i] or "", add_special_tokens=False).ids, texts[i]


ROWS = [(i, " ".join(f"word{i % 7}x{j}" for j in range(i % 23)), "r", 1) for i in range(120)] + [(5, "again", "r", 2), (5, "again", "r", 2), (None, None, None, None), (None, "", "", 3), (900, "very long text " * 300, "s", 4)]


@pytest.mark.parametrize("capacity", [40, 2048])
def test_pieces(spark, library, capacity):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, task string, rank int").repartition(3)
    out = P.best_two_fit(docs, tokenizer_path(), capacity).collect()
    want = []
    for key, text, *_ in ROWS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, i in enumerate(range(0, len(ids), capacity)):
            part = ids[i : i + capacity]
            want.append((key, k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in out))) == sorted(map(str, want))
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        ends = [0]
        for offset, length in sorted(rows):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    assert len(by) == len(one_at_a_time([x[3] for x in want], capacity))
    assert P.best_two_fit(docs.limit(0), tokenizer_path(), capacity).count() == 0
