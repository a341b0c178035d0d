"""The Merkle manifest and fill-in-the-middle against plain Python."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fim_units, merkle_pregel

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, grp int, digest string, key string, row int, block int"


def rows_of(n):
    out = [(i, f"text {i}\nzwei é {'x' * (i % 5)}", "en", "big", 10 + i) for i in range(n)]
    out += [(1, "one\n", None, None, None), (None, None, "de", "", 0), (None, "a\nb", "de", "", 0), (7, "same\n", "de", "b", 5), (7, "same\n", "de", "b", 5), (8, "same", "de", "b", 5), (9, None, "fr", "É", 2)]
    return [(*r, "p", 1, "d", "k", 2, 3) for r in out]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def tree(level):
    """Root of a list of digests, and the (before, behind) of each, level by level."""
    paths, spots = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, s in enumerate(spots):
            run = s - s % 3
            paths[i].append(("".join(level[run:s]), "".join(level[s + 1 : run + 3])))
        spots = [s // 3 for s in spots]
        level = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, leaf_of(r, r[1])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made[s] = tree([x[1] for x in groups[s]])
    root, tops = tree([made[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (r, leaf), path in zip(groups[s], made[s][1], strict=True):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now = leaf_of(r, r[1].replace("\n", "")) if cut else leaf
            for a, b in [*path, *top]:
                now = digest(a, now, b)
            out.append((r[0], leaf, made[s][0], root, digest(*[x for p in [*path, *top] for x in p]), now, now == root))
    return out


def even_lose_line_ends(docs):
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("n", [0, 4, 2600])
def test_manifest(spark, n):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in merkle_pregel.merkle_manifest(docs, even_lose_line_ends(docs)).collect()]
    want = brute(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[-1] for r in got} == {True, False}
    untampered = merkle_pregel.merkle_manifest(docs).collect()
    assert all(r.verified for r in untampered) and len(untampered) == len(rows)


def test_small_manifests(spark):
    docs = spark.createDataFrame(rows_of(0), SCHEMA)
    one = merkle_pregel.merkle_manifest(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == digest()
    assert merkle_pregel.merkle_manifest(docs.where("doc_id = -1")).collect() == []


def test_a_missing_child_is_found():
    nodes = [("g", i, 5, str(i)) for i in range(5)]
    assert [x[1:3] for x in merkle_pregel.forward(nodes)] == [(0, 2), (1, 2)]
    with pytest.raises(ValueError):
        list(merkle_pregel.forward(nodes[:-1]))


def units(r):
    doc_id, text = r[0], r[1] or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    hexes = digest("1:", "null" if doc_id is None else str(doc_id))
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    texts = [None, "", "a", " ", "word", "日本 語🎉x", "a <P> b", "x<S", "<M", "a\nb\r\n", "1234567890 " * 40, "ab " * 16, "ab " * 48, "abc", "x" * 50_000 + " y", "word " * 20_000]
    rows = [(i, texts[i % len(texts)], "en", "s", 1, "p", 1, "d", "k", 2, 3) for i in range(400)]
    rows += [(None, "null id here", "en", "s", 1, "p", 1, "d", "k", 2, 3), (3, "twice the same row", "en", "s", 1, "p", 1, "d", "k", 2, 3), (3, "twice the same row", "en", "s", 1, "p", 1, "d", "k", 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = fim_units.fill_in_middle(docs)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(units(r)) for r in rows)
    back = out.select("doc_id", fim_units.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    assert fim_units.fill_in_middle(docs.limit(0)).count() == 0
