import random

import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe_verify as B


@pytest.fixture(scope="module")
def both():
    tokenizer = Tokenizer.from_file(B.tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, B.model_of(B.tokenizer_path())


def check(both, texts):
    tokenizer, model = both
    ids, at = B._Coder(model).encode(texts, [any(c >= model.tables.first_byte for c in (x or "").encode()) for x in texts])
    for i, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False)
        got = ids[at[i] : at[i + 1]].tolist()
        assert got == want.ids, text
        assert " ".join(model.strings[t] for t in got) == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_edges(both):
    check(both, [None, "", "  \n\t", "a", "Hello, WORLD's 2024!!", "x<|endoftext|>Y<|startoftext|>", "ΣΑΣ İstanbul ẞ", "été   x\x85y\x1cz", "日本語テキスト 🎉🎉🎉", "a" * 3000, "1234567890 ½ ⅷ", "</w></w>", "don't we'll I'VE"])


def test_random_words(both):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéèñü'ß0 .,!-\n#"
    check(both, ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(3000)])
    pieces = [x.replace("</w>", "") for x in both[1].strings[600:20000] if x.isascii() and x.replace("</w>", "").isalpha()]
    check(both, ["".join(rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(4000)])


def test_some_words_fail_the_check(both):
    _, model = both
    rng = random.Random(1)
    pieces = [x.replace("</w>", "") for x in model.strings[600:20000] if x.isascii() and x.replace("</w>", "").isalpha()]
    raws = ["".join(rng.choices(pieces, k=3)).encode() for _ in range(2000)]
    exact = [model.merged(x) for x in raws]
    assert model.encode_words(raws) == exact
    assert sum(model.greedy(x) != y for x, y in zip(raws, exact, strict=True)) > 20


def test_frames(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "Hi there", "x"), (1, "Hi there", "x"), (None, None, None)], "doc_id long, text string, ids string")
    out = B.digests(B.bpe_encode(docs, B.tokenizer_path())).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in out] == [0, 2, 2]
    assert B.bpe_encode(docs.where(F.lit(False)), B.tokenizer_path()).count() == 0


def test_every_code_point(both):
    """Letters, numbers, spaces and lower case are the library's, whatever this Python's Unicode version."""
    tokenizer, model = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    coder = B._Coder(model)
    for i in range(0, len(points), 64_000):
        texts = [" ".join(f"a{chr(c)}1 !{chr(c)}" for c in points[j : j + 64]) for j in range(i, min(i + 64_000, len(points)), 64)]
        ids, at = coder.encode(texts, [any(x >= model.tables.first_byte for x in t.encode()) for t in texts])
        for k, want in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert want.ids == ids[at[k] : at[k + 1]].tolist(), hex(points[i + 64 * k])
