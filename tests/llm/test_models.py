"""Language ID, language-model scores and the pipeline."""

import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, lm_diff

SF = "/root/testdata/sf0.001"


def made(n=60, seed=4):
    """Four invented languages, two in a family."""
    rng = random.Random(seed)
    parts = {"en": "th er ing wh on", "de": "sch ei ung pf ch", "fr": "eau é oi elle ç", "es": "ción ñ ado os ez"}
    rows = []
    for lang, p in parts.items():
        for _ in range(n):
            rows.append((len(rows), " ".join("".join(rng.choices(p.split(), k=rng.randrange(1, 5))) for _ in range(rng.randrange(8, 60))), lang))
    return rows


def brute_losses(talk, docs, split, back):
    """The two mean losses of a document's words. back: None if the documents are the background, each without itself."""
    pairs = [Counter(p for t in side for p in zip(split(t), split(t)[1:])) for side in (talk, docs if back is None else back)]
    heads = [Counter(), Counter()]
    one = [Counter(), Counter()]
    for j in (0, 1):
        for (a, b), n in pairs[j].items():
            heads[j][a] += n
            one[j][b] += n
    totals = [sum(x.values()) for x in one]
    symbols = max(lm_diff.SYMBOLS, len({*one[0], *one[1], "<s>"}))
    scale = [min(1.0, (min(totals) or max(totals)) / max(1, n)) for n in totals]

    def loss(w):
        mine, fronts, out = Counter(zip(w, w[1:])), Counter(w[:-1]), []
        for j in (0, 1):
            own = j == 1 and back is None
            total = 0.0
            for (a, b), m in mine.items():
                c, h = pairs[j][a, b] - own * m, heads[j][a] - own * fronts[a]
                prior = lm_diff.PRIOR * (scale[j] * one[j][b] + 1) / (scale[j] * totals[j] + symbols)
                total -= m * math.log((scale[j] * c + prior) / (scale[j] * h + lm_diff.PRIOR))
            out.append(total / (len(w) - 1))
        return out

    return loss


def check_losses(r, w, loss):
    assert r.n_tokens == len(w) - 1
    if len(w) == 1:
        assert r.score is None
    else:
        assert [r.loss_target, r.loss_background] == pytest.approx(loss(w), abs=1e-6)
        assert r.score == pytest.approx(r.loss_target - r.loss_background)


def test_languages(spark):
    rows = made() + [(900, None, "en"), (901, "", None), (902, "123 — €", "fr"), (903, "ÉEAU OI ELLE", None), (None, "sch ei ung", "de"), (1, "sch ei ung", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.language_id(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows if i is not None and i not in (1, 900, 901, 902, 903)}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 30 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r.lang_pred for r in got}
    assert (by[900], by[901], by[902], by[903], by[None]) == ("und", "und", "und", "fr", "de")
    assert langid.language_id(docs.limit(0)).count() == 0


def test_any_number_of_labels(spark):
    """Seventy invented languages of one family each, and rare ones as well as frequent ones, are all learned."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sets = [rng.sample(letters, 4) for _ in range(70)]
    rows = [(len(sets) * j + i, " ".join("".join(rng.choices(sets[i], k=5)) for _ in range(40)), f"x{i}") for j in range(5) for i in range(70)]
    got = {r.doc_id: r.lang_pred for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(set(got.values())) >= 68
    assert sum(got[i] == lang for i, _, lang in rows) > 0.9 * len(rows)


def test_prediction_against_brute_force(spark):
    """The machines applied to one text at a time, in plain Python."""
    import numpy as np

    docs = spark.createDataFrame(made(30), "doc_id long, text string, lang string")
    m = langid.train(docs, ~langid.held_out())
    for r in langid.language_id(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = r.text.lower().encode()
        raw = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in raw) + b"  "
        cells = [((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.DIM_BITS) for a, b, c in zip(raw, raw[1:], raw[2:])]
        margin = m.weights[cells].astype(float).mean(0) + m.bias
        f = int(np.argmax(margin[: len(m.families)]))
        votes = {x: [0.0, 9.0] for x in m.members[f]}
        for j, (g, a, b) in enumerate(m.pairs):
            if g == f:
                v = margin[len(m.families) + j]
                votes[a] = [votes[a][0] + (v > 0) + 1e-3 * math.tanh(v), min(votes[a][1], v)]
                votes[b] = [votes[b][0] + (v <= 0) - 1e-3 * math.tanh(v), min(votes[b][1], -v)]
        best = max(sorted(votes), key=lambda x: votes[x][0])
        assert r.lang_pred == m.languages[best]
        assert r.score == pytest.approx(1 / (1 + math.exp(-3 * min(margin[f], votes[best][1]))), abs=1e-4)


def test_labels_do_not_leak(spark):
    """Labels of held-out rows change nothing."""
    docs = spark.createDataFrame(made(20), "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    pick = lambda d: sorted(map(tuple, langid.language_id(d).collect()))
    assert pick(docs) == pick(other)


def test_one_or_no_language(spark):
    docs = spark.createDataFrame([(i, f"word number {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language_id(docs).collect()} == {"en"}
    assert {(r.lang_pred, r.score) for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = langid.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_model_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words[:20], k=rng.randrange(1, 40))), "n") for i in range(40)] + [(50, None, "n"), (51, "?!", "n")]
    talk = [(" ".join(rng.choices(words[10:], k=20)).upper(),) for _ in range(25)] + [(None,)]
    got = lm_diff.lm_difference(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(talk, "text string")).collect()

    split = lambda t: ["<s>", *re.findall("[a-z0-9]+", (t or "").lower())]
    by = {i: t for i, t, _ in docs}
    loss = brute_losses([t for (t,) in talk], list(by.values()), split, None)
    for r in got:
        check_losses(r, split(by[r.doc_id]), loss)


@pytest.mark.parametrize("known,apart", [(1 << 19, False), (2500, True), (100, False)])
def test_every_word_has_its_own_counts(spark, known, apart):
    """More words than the tables have; nearly all of them rare."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    text = lambda: " ".join(words[int(5000 * rng.random() ** 2)] for _ in range(rng.randrange(1, 60)))
    docs, talk, back = [text() for _ in range(250)] + [None, ""], [text() for _ in range(120)], [text() for _ in range(200)]
    docs += [docs[3], " ".join(rng.choices(words, k=30) + ["never", "seen"])]
    ids = [*range(len(docs) - 2), 3, None]
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    got = lm_diff.lm_difference(spark.createDataFrame(list(zip(ids, docs)), "doc_id long, text string"), frame(talk), frame(back) if apart else None, known=known, per_bucket=700).collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got)
    split = lambda t: ["<s>", *(t or "").split()]
    loss = brute_losses(talk, docs, split, back if apart else None)
    by = dict(zip(ids, docs))
    for r in got:
        check_losses(r, split(by[r.doc_id]), loss)


def test_copies_elsewhere_are_scored_apart(spark):
    """Each text is scored without itself, so one that comes twice is known to the background and one that comes once is not."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"v{i}" for i in range(900)], k=60)) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate([*texts, *texts[:10]])]
    got = {r.doc_id: r.score for r in lm_diff.lm_difference(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("v1 v2 v3",)] * 300, "text string")).collect()}
    twice = [got[i] for i in [*range(10), *range(40, 50)]]
    assert min(twice) > max(got[i] for i in range(10, 40))


def test_smoothing_is_a_distribution():
    """Over all symbols the smoothing terms sum up to PRIOR, so that p(w|h) sums up to one."""
    import numpy as np

    rng = np.random.default_rng(0)
    words, counts, totals = rng.integers(1, 1 << 60, 500).astype(np.uint64), rng.integers(0, 9, (500, 4)), np.array([4000, 90000])
    counts[:, [0, 2]] = totals / 500
    v = lm_diff.Vocabulary(words, counts, totals, 3000, True)
    assert v.scale.tolist() == [1.0, pytest.approx(4000 / 90000)]
    assert v.prior.sum(0) + (3000 - 500) * v.floor == pytest.approx(lm_diff.PRIOR)


def test_empty_collections(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm_diff.lm_difference(none, one).count() == 0
    assert lm_diff.lm_difference(one, none).first().loss_target == pytest.approx(math.log(lm_diff.SYMBOLS), abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    from corpusloom.llm import fm_decontam, ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < len(C.STAGES) - 1:
            assert tuple(seen[-1].columns) == C.COLUMNS and seen[-1].dtypes == docs.dtypes
    sizes = [d.count() for d in seen]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0]
    groups = ngram_join.ngram_jaccard_join(seen[2])
    assert sorted(r[0] for r in seen[3].select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hits = lambda d: fm_decontam.fm_decontaminate(d, bench).agg(F.sum("n_hit")).first()[0]
    assert hits(seen[3]) > 0 and hits(seen[4]) == 0
    clean = fm_decontam.fm_decontaminate(seen[3], bench).where("n_hit = 0").select("doc_id", "text")
    assert clean.exceptAll(seen[4].select("doc_id", "text")).count() == 0
    assert C.run(spark, SF).select("doc_id", "n_tokens").exceptAll(seen[5].select("doc_id", "n_tokens")).count() == 0


def test_stages_of_odd_tables(spark):
    import corpus_pipeline as C

    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (2, "the same words here and there", "en", "s", 1), (2, "the same words here and there", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            assert stage(spark, d, SF).count() <= d.count()
    assert C.near_duplicates(spark, docs, SF).count() == 3
