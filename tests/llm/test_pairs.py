"""The n-gram join, line dedup, decontamination and license scan against brute force."""

import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import _kernels as K
from corpusloom.llm import fm_decontam, license_scan, line_dedup, ngram_join


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    prose = lambda n: rng.choices(words, k=n)
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    common = prose(40)
    for size in (4, 5, 6, 7, 8, 9, 12, 30, 60, 200):
        base = prose(size)
        for edits in (0, 0, 0, 1, 1, 1, 2, 3, 4, 6, 8, 10):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t += prose(max(1, len(t) // 6))
            texts.append(" ".join(t))
    group = prose(60)  # a large group of near copies
    for _ in range(90):
        t = list(group)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4))):
            t[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(t))
    for _ in range(60):  # a passage that many have
        texts.append(" ".join(prose(rng.randrange(3, 60)) + common + prose(rng.randrange(3, 30))))
    return texts


@pytest.mark.parametrize("bits, heavy", [(24, 256), (14, 256), (24, 30)])
def test_join_is_complete(spark, bits, heavy):
    """With 2 ** 14 cells nearly all tokens count as frequent, so pairs of tokens are what finds the links. With ``heavy`` 30
    tokens are found to be frequent by key, round after round."""
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs, cell_bits=bits, heavy=heavy).collect())
    assert got == components(texts)


def test_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e F"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_join(docs).collect()), key=str)
    assert got == [(1, 1), (2, 2), (3, 1), (3, 1), (None, None)]
    assert ngram_join.ngram_jaccard_join(docs.where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        ngram_join.ngram_jaccard_join(docs, percent=50)


def test_any_classes_are_complete():
    """Whatever the classes, similar sets share a signature."""
    rng = random.Random(9)
    import numpy as np

    for _ in range(1500):
        n = rng.randrange(3, 120)
        pool = np.array(rng.sample(range(1, 1 << 60), 2 * n + 4), np.uint64)
        a, b = set(pool[:n].tolist()), set(pool[:n].tolist())
        while True:
            c = set(b)
            if rng.random() < 0.6:
                c.discard(rng.choice(sorted(c)))
            if rng.random() < 0.6:
                c.add(int(rng.choice(pool)))
            if 100 * len(a & c) < 75 * len(a | c) or rng.random() < 0.03:
                break
            b = c
        weights = rng.choice([(1, 1, 1), (1, 1, 9), (0, 0, 1), (9, 1, 1), (1, 0, 30)])
        level = {x: rng.choices((0, 1, 2), weights)[0] for x in a | b}
        found = []
        for s in (a, b):
            t = np.array(sorted(s), np.uint64)
            rare, often = ngram_join.signatures(t, np.array([level[x] for x in t.tolist()]), 75)
            found.append((set(rare.tolist()), set(often.tolist())))
        assert found[0][0] & found[1][0] or found[0][1] & found[1][1] or a == b


def test_line_dedup_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    lines = ["".join(rng.choices("abcde fg", k=rng.randrange(0, 30))) for _ in range(60)] + [" ".join(["w"] * 50), "", " "]
    block = rng.sample(lines, 16)
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 12)) + (block if i % 3 == 0 else []) + rng.choices(lines, k=2)), "c") for i in range(120)]
    rows += [(5, rows[5][1], "c"), (None, rows[6][1], None), (200, None, "x"), (201, "", "y"), (202, "\n\n\n", "y"), (203, "a\n" * 3000, "z"), (204, "a\n" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    for c in ("gone", "_k", "_l", "_n", "_carried", "_salt", "hash", "a.b"):  # names that the operator uses itself
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(str(tmp_path / "d"))
    out = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert got == sorted(con.execute(line_dedup.SQL).fetchall(), key=str)
    assert sum(r[3] for r in got) > 30
    assert {tuple(r) for r in line_dedup.dedup_lines(docs).select("gone", "_k", "_n", "_carried", "`a.b`").collect()} == {("mine",) * 5}
    assert line_dedup.dedup_lines(docs.where(F.lit(False))).count() == 0


def test_chunks_resist_shifts(spark):
    rng = random.Random(8)
    body = ["".join(rng.choices("abcdefg", k=12)) for _ in range(60)]
    other = ["".join(rng.choices("hijklmn", k=12)) for _ in range(7)]
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(other + body[:30] + other[:1] + body[30:]))], "doc_id long, text string")
    r = line_dedup.dedup_lines(docs).where("doc_id = 2").first()
    assert r.n_removed_lines >= 40
    assert set(other) <= set(r.text.split("\n"))


def brute_hits(text, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(10, len(v))
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_decontamination(spark, tmp_path):
    rng = random.Random(1)
    vocab = ["ab", "cd", "é", "f1", "gh"]
    prose = lambda n, v=vocab: " ".join(rng.choices(v, k=n))
    items = [(1, prose(14)), (2, prose(10)), (10, "zz yy!"), (3, None), (4, "..."), (5, prose(25)), (5, prose(11))]
    texts = [None, "", "?!", "ZZ--yy zz yy", items[0][1].upper() + "." + items[1][1]] + [prose(rng.randrange(1, 90)) for _ in range(60)]
    for _ in range(60):
        a, b = rng.choice([i for i in items if i[1]]), rng.randrange(0, 6)
        w = a[1].split()
        texts.append(prose(rng.randrange(5)) + " other " * (b % 2) + ", ".join(w[b : b + rng.randrange(8, 20)]) + " x " + prose(20, ["q", "ab", "é"]))
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 1):  # one block, and one for each item
        found = fm_decontam.fm_decontaminate(docs, bench, block_bytes=limit)
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in found.collect()}
        assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    stored = fm_decontam.index_shards(docs, str(tmp_path / "index"))  # made without the benchmark, searched for two
    for wanted in (items, items[:2]):
        some = spark.createDataFrame(wanted, "item_id long, text string")
        got_ = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in fm_decontam.search_shards(stored, some).collect()}
        assert got_ == {i: brute_hits(t, wanted) for i, t in enumerate(texts)}
    odd = docs.withColumn("row", F.lit("mine")).withColumn("a.b", F.lit(1))
    assert fm_decontam.fm_decontaminate(odd, bench, carry=("doc_id", "row", "a.b", "items")).columns == ["doc_id", "row", "a.b", *fm_decontam.NEW]
    clean = fm_decontam.without_spans(found)
    assert {r.doc_id: r.text for r in clean.where("n_hit = 0").collect()} == {i: t for i, t in enumerate(texts) if got[i][1] == 0}
    assert clean.where("doc_id = 3").first().text == ""
    again = fm_decontam.fm_decontaminate(clean.where("n_hit > 0"), bench)
    assert again.agg(F.sum("n_hit")).first()[0] < 0.2 * found.agg(F.sum("n_hit")).first()[0]
    assert fm_decontam.fm_decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert fm_decontam.fm_decontaminate(docs.limit(0), bench).count() == 0


def test_fm_index_counts():
    import numpy as np

    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 5), [0], np.ones(80, int), [0]])
    index = fm_decontam.FMIndex.of(text, 4)
    for k in (1, 2, 3, 7):
        pats = rng.integers(1, 4, (40, k))
        low, high = index.search(pats, np.full(40, k))
        for p, a, b in zip(pats, low, high, strict=True):
            want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == want


def test_licenses(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"][1], license_scan.TEMPLATES["GPL-3.0"][0]
    edited = mit.replace("without restriction", "with no restriction at all").replace("free of charge, ", "")
    rows = [(1, f"é prose here. {mit} more"), (2, edited), (3, gpl.upper()), (4, "the license of the software is free for any person"), (5, None), (6, ""), (7, f"{gpl} {mit}"), (8, mit[: len(mit) // 3])]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, matches string")
    got = {r.doc_id: [(m.license, m.start, m.end) for m in r.matches] for r in license_scan.license_scan(docs).collect()}
    assert got[1] == [("MIT", 14, 14 + len(mit) - 1)]
    assert [m[0] for m in got[2]] == ["MIT"] and [m[0] for m in got[3]] == ["GPL-3.0"]
    assert [m[0] for m in got[7]] == ["GPL-3.0", "MIT"]
    assert got[4] == got[5] == got[6] == got[8] == []
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_winnowing_guarantee():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        grams, group = rng.integers(0, 9, n).astype(np.uint64), np.sort(rng.integers(0, 3, n))
        kept = set(license_scan.winnow(grams, group).tolist())
        for g in range(3):
            at = np.flatnonzero(group == g)
            for i in range(max(1, len(at) - license_scan.WINDOW + 1)) if len(at) else ():
                assert kept & set(at[i : i + license_scan.WINDOW].tolist())


def test_kernels_split_like_regex():
    rng = random.Random(0)
    texts = ["".join(rng.choices("aB1 \té\n.-", k=rng.randrange(0, 40))) for _ in range(300)] + [None, ""]
    import pyarrow as pa

    for limit in (64, 1 << 20):
        out = []
        for _, _, data, offsets in K.slices(pa.array(texts), limit):
            starts, ends, doc = K.split_words(data, offsets, K.SPACE)
            part = [[] for _ in range(len(offsets) - 1)]
            for s, e, d in zip(starts, ends, doc, strict=True):
                part[d].append(data[s:e].tobytes().decode())
            out += part
        assert out == [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]


def test_bucket_bound_is_a_bound(spark):
    """The lanes' arithmetic against sets: never less than what two sets share."""
    import numpy as np

    rng = random.Random(12)
    rows, wants = [], []
    for i in range(400):
        pool = rng.sample(range(1, 1 << 62), 160)
        a, b = (set(rng.sample(pool, rng.randrange(1, 160))) for _ in range(2))
        meta = [len(s) << 32 | len(s) << 1 for s in (a, b)]
        rows.append((i, *meta, *(x for s in (a, b) for x in ngram_join.sketch(np.array(sorted(s), np.uint64)))))
        wants.append(100 * len(a & b) >= 75 * len(a | b))
    names = ["i", "meta_a", "meta_b", *(f"s{j}_{c}" for c in "ab" for j in (1, 2, 3))]
    kept = {r.i for r in spark.createDataFrame(rows, names).where(ngram_join._sharing(75)).collect()}
    assert {i for i, w in enumerate(wants) if w} <= kept and len(kept) < 400


def test_licenses_cut_off_or_back_to_back(spark):
    rows = []
    for name in ("MIT", "Apache-2.0", "BSD-2-Clause"):
        words = license_scan.TEMPLATES[name][1 if name != "BSD-2-Clause" else 0].split()
        rows.append((len(rows), "prose here " + " ".join(words[: int(0.85 * len(words))]), [name]))
    for name, text in (("MIT", license_scan.TEMPLATES["MIT"][0]), ("CC-BY-NC-4.0", license_scan.TEMPLATES["CC-BY-NC-4.0"][0]), ("Apache-2.0", license_scan.TEMPLATES["Apache-2.0"][0])):
        for n in (2, 3):
            rows.append((len(rows), " ".join([text] * n), [name] * n))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: [m.license for m in r.matches] for r in license_scan.license_scan(docs).collect()}
    assert got == {i: names for i, _, names in rows}


def test_repeated_passages_of_short_lines(spark):
    rng = random.Random(14)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    rows, want = [], {}
    for n in (2, 3, 4, 6, 8, 10):
        for _ in range(6):
            passage = [line(52 // n + 1) for _ in range(n)]
            if n > 3:
                passage[2:2] = [""]
            for copy in (0, 1):
                head, tail = ([line(rng.randrange(1, 12)) for _ in range(5)] for _ in range(2))
                want[len(rows)] = "\n".join(head + (passage if not copy else []) + tail)
                rows.append((len(rows), "\n".join(head + passage + tail)))
    twice = [line(30) for _ in range(2)]
    want[900], want[901] = "\n".join(twice), "\n".join([*twice, "end"])
    rows += [(900, want[900]), (901, "\n".join([line(9)] * 3 + ["end"]))]
    want[901] = rows[-1][1]
    rows.append((902, "\n".join([*twice, *twice, "x"])))
    want[902] = "x"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, passages=True).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert got[1].n_removed_lines == 2 and got[1].n_removed_chunks == 1 and got[902].n_removed_lines == 4
    same = spark.createDataFrame([(1, "\n".join(["q w"] * 3000))], "doc_id long, text string")
    assert line_dedup.dedup_lines(same, passages=True).first().n_lines == 3000


def test_parities_bound_the_difference_and_tell_unlike_sets_apart(spark):
    rng = random.Random(11)
    rows, similar = [], {}
    for i in range(300):
        n, both = rng.choice((3, 40, 256, 900)), rng.random()
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: int(both * n)]) | {rng.getrandbits(64) for _ in range(n - int(both * n))}
        similar[i] = len(a & b) / len(a | b)
        x, y = (ngram_join.parity(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)
        rows.append((i, len(a) << 32, len(b) << 32, x.tolist(), y.tolist()))
    made = spark.createDataFrame(rows, "i long, meta_a long, meta_b long, par_a array<long>, par_b array<long>")
    kept = {r.i for r in made.where(ngram_join._differing(75)).collect()}
    assert kept >= {i for i, s in similar.items() if s >= 0.75} and not any(similar[i] < 0.5 for i in kept)


def test_a_pair_of_two_components_is_made_once_for_lists_of_the_same_documents(spark):
    lists = {s: (1, 2, 3) for s in range(50)} | {50: (1, 2), 51: (3, 4), 52: (5, 6)}
    label = {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}
    meta = {d: (400 if d == 4 else 100) << 32 for d in label}  # 4 is too large for 3
    rows = [(s, d, meta[d], label[d]) for s, docs in lists.items() for d in docs]
    got = ngram_join._in_short_lists(spark.createDataFrame(rows, "sig long, doc_id long, meta long, label long"), 75).collect()
    assert sorted((r.a, r.b, r.w) for r in got) == [(1, 2, 1), (1, 2, 50), (1, 3, 50)]


def test_long_lists_are_dealt_into_blocks_and_make_each_pair_that_may_be_similar_once(spark):
    """1,500 documents of one list, and short lists: the same pairs as by SQL, whatever the blocks, and none of them large."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows = []
    for d in range(1500):
        keep = base[:50] if d % 3 else rng.sample(base, 20)
        s = np.array(sorted({*keep, *(rng.getrandbits(64) for _ in range(d % 25))}), np.uint64)
        meta = len(s) << 32 | len(s) << 1
        rows += [(sig, d, meta, *ngram_join.sketch(s), ngram_join.parity(s).tolist(), d % 7) for sig in ([1] if d >= 40 else [1, 2 + d // 4])]
    left = spark.createDataFrame(rows, "sig long, doc_id long, meta long, s1 long, s2 long, s3 long, par array<long>, label long").cache()
    open_ = left.groupBy("sig").agg(F.count("*").alias("docs"))
    x, y = (left.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in left.columns[1:]]) for s in "ab")
    want = x.join(y, "sig").where("doc_id_a < doc_id_b and label_a <> label_b").where(ngram_join._near("meta_a", "meta_b", 75, "true"))
    want = {tuple(r) for r in want.where(f"({ngram_join._sharing(75)}) and {ngram_join._differing(75)}").select("doc_id_a", "doc_id_b").distinct().collect()}
    assert len(want) > 1000
    for block in (100, 5000):
        found = ngram_join._in_long_lists(left, open_, 75, block)
        one = found.where("a >= 40 or b >= 40").collect()
        assert len({(r.a, r.b) for r in one}) == len(one)
        assert {(r.a, r.b) for r in found.collect()} == want


def test_decontamination_takes_a_carried_text_from_its_row(spark):
    """The text is sent to Python once, and the result is that of a text beside the row."""
    block = pickle.dumps(fm_decontam.Windows([("q", "a b c d e f g h i j")], 10))
    blocks = [type("Block", (), {"value": zstandard.ZstdCompressor().compress(block)})]
    texts = ["x a b c d e f g h i j y", None, "k"]
    row = pa.StructArray.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    one = list(fm_decontam._search(blocks)([pa.RecordBatch.from_arrays([row.slice(1)], ["row"]), pa.RecordBatch.from_arrays([row], ["row"])]))
    two = list(fm_decontam._search(blocks)([pa.RecordBatch.from_arrays([row, pa.array(texts)], ["row", "text"])]))
    assert one[1].equals(two[0]) and two[0].column("n_hit").to_pylist() == [10, 0, 0] and one[0].column("n_words").to_pylist() == [0, 1]


def test_stages_of_the_pipeline_send_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert corpus_pipeline._in_small_batches(spark, "test", sizes).agg(F.max("n"), F.sum("n")).first()[:] == (1000 if before == "10000" else min(int(before), 3000), 3000)
    assert spark.conf.get(name) == before
