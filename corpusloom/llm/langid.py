"""Operator 4: language identification by hierarchical discrimination.

Method. A text is the mean of its byte trigrams' weights (letters in lower case, all else one space). Linear support vector
machines first tell language families apart, one against the rest; then, within the predicted family, one machine for every
two languages votes, and the language with the most votes (then the greatest sum of margins) wins.

Training. On at most PER_LANGUAGE labelled rows of each language: those with the least hashes of doc_id and text, over all
rows, so the sample does not depend on how rows are dealt out. What comes to the driver are trigram counts of fixed length.
All labels are learned, however rare. The squared hinge is minimised on the driver, where the sample's size is labels times
PER_LANGUAGE. The weights (a table of DIM rows) are broadcast. Prediction has no shuffle, and lang, source and doc_id are not
among its inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _kernels as K

DIM_BITS = 13
DIM = 1 << DIM_BITS
PER_LANGUAGE = 600  # bound of the training sample
#: Families of well-known languages. Any other language is a family of its own.
FAMILIES = {
    **dict.fromkeys(("da", "de", "en", "is", "nl", "no", "sv"), "germanic"),
    **dict.fromkeys(("ca", "es", "fr", "gl", "it", "la", "pt", "ro"), "romance"),
    **dict.fromkeys(("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"), "slavic"),
    **dict.fromkeys(("et", "fi", "hu"), "uralic"),
    **dict.fromkeys(("az", "kk", "tr", "uz"), "turkic"),
}

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all byte trigrams within documents, and where each document's begin and end. Two spaces follow each text;
    runs of non-letters count as they stand."""
    x = _FOLD[data]
    if len(x) > 1:  # upper-case Latin-1 letters in UTF-8
        x[1:][(x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] < 0x9F) & (x[1:] != 0x97)] += 0x20
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1  # behind a text there are spaces, not the next one
    second = np.append(x[1:], np.uint8(0x20))[: len(x)]
    second[ends] = 0x20
    third = np.append(second[1:], np.uint8(0x20))[: len(x)]
    third[ends] = 0x20
    code = x.astype(np.uint32) << 16 | second.astype(np.uint32) << 8 | third
    cell = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)).astype(np.int64)
    return cell, offsets


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum((_FOLD[data] != 0x20) & (data < 0x80))])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Machines:
    """Weights of all machines: columns of families first, then of pairs of languages within families."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3):
        """x: shares of trigrams, a row for each example (scaled in place); y: the example's language."""
        self.languages = languages
        self.families = sorted({FAMILIES.get(v, v) for v in languages})
        family = np.array([self.families.index(FAMILIES.get(v, v)) for v in languages])
        self.members = [[i for i in range(len(languages)) if family[i] == f] for f in range(len(self.families))]
        self.pairs = [(f, a, b) for f, m in enumerate(self.members) for i, a in enumerate(m) for b in m[i + 1 :]]
        scale = 1 / np.sqrt(x.mean(0) + 1e-5) if len(x) else np.ones(DIM)
        z = np.multiply(x, scale, out=x, casting="same_kind") if len(x) else x
        columns = [(np.where(family[y] == f, 1.0, -1.0), np.ones(len(y), bool)) for f in range(len(self.families))]
        columns += [(np.where(y == a, 1.0, -1.0), (y == a) | (y == b)) for _, a, b in self.pairs]
        self.bias, weights = np.zeros(len(columns)), np.zeros((DIM, len(columns)))
        for j, (t, use) in enumerate(columns):
            if len(set(t[use])) == 2:
                weights[:, j], self.bias[j] = _train(z if use.all() else z[use], t[use].astype(np.float32), rounds, penalty)
        self.weights = (weights * scale[:, None]).astype(np.float32)

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence for rows of margins."""
        n, f = len(margins), len(self.families)
        top = margins[:, :f].argmax(1) if f > 1 else np.zeros(n, int)
        lang, sure = np.zeros(n, int), np.full(n, 9.0) if f == 1 else margins[np.arange(n), top]
        for k, m in enumerate(self.members):
            rows = np.flatnonzero(top == k)
            votes = np.zeros((len(rows), len(m)))
            least = np.full((len(rows), len(m)), 9.0)
            for j, (g, a, b) in enumerate(self.pairs):
                if g == k:
                    v, ia, ib = margins[rows, f + j], m.index(a), m.index(b)
                    votes[:, ia] += np.where(v > 0, 1, 0) + 1e-3 * np.tanh(v)
                    votes[:, ib] += np.where(v > 0, 0, 1) - 1e-3 * np.tanh(v)
                    least[:, ia], least[:, ib] = np.minimum(least[:, ia], v), np.minimum(least[:, ib], -v)
            best = votes.argmax(1)
            lang[rows] = np.array(m)[best]
            sure[rows] = np.minimum(sure[rows], least[np.arange(len(rows)), best])
        return lang, 1 / (1 + np.exp(-np.clip(3 * sure, -30, 30)))


def _train(x: np.ndarray, t: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Squared hinge and a quadratic penalty, by accelerated gradient steps; both sides weigh the same. The last number of a
    vector is for the bias."""
    c = np.where(t > 0, 0.5 / (t > 0).sum(), 0.5 / (t < 0).sum()).astype(np.float32)
    forth = lambda v: x @ v[:-1] + v[-1]
    back = lambda r: np.append(x.T @ r, r.sum())
    v = np.random.default_rng(0).standard_normal(x.shape[1] + 1).astype(np.float32)
    for _ in range(20):  # greatest curvature, by power iteration
        v = back(c * forth(v))
        v /= np.linalg.norm(v)
    step = 1 / (2.2 * np.linalg.norm(back(c * forth(v))) + penalty)
    w = u = np.zeros(x.shape[1] + 1, np.float32)
    for i in range(rounds):
        slack = np.maximum(0, 1 - t * forth(u))
        new = u - step * (penalty * u - 2 * back(c * t * slack))
        u, w = new + i / (i + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _counts(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for a, b, data, offsets in K.slices(batch.column(1)):
            cell, at = trigrams(data, offsets)
            body = [pack.compress(np.bincount(cell[at[i] : at[i + 1]], minlength=DIM).astype("<u4").tobytes()) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(body, pa.binary())], ["lang", "counts"])


def train(docs: DataFrame, eligible, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Machines:
    """Learns from a bounded sample of the eligible rows with a label and a text."""
    rows = docs.where(eligible).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key), F.col(text).cast("string")).alias("u")).where("t is not null and lang is not null")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Machines([], np.zeros((0, DIM)), np.zeros(0, int))
    # about twice as many as wanted by a bound on the hash, so that few rows are sorted; then the first of these
    bound = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, (2.0 * per_language + 50) / r["count"]))])
    share = (F.col("u").cast("double") + 2.0**63) / 2.0**64
    first = F.row_number().over(W.partitionBy("lang").orderBy("u", "t"))
    sample = rows.where(share <= F.element_at(bound, F.col("lang"))).withColumn("r", first).where(F.col("r") <= per_language)
    packs = sample.select("lang", "t").mapInArrow(K.tidy(_counts), "lang string, counts binary").collect()
    packs.sort(key=lambda r: (r.lang, r.counts))
    open_ = zstandard.ZstdDecompressor()
    languages = sorted(r["lang"] for r in sizes)
    x = np.empty((len(packs), DIM), np.float32)
    for i, r in enumerate(packs):
        x[i] = np.frombuffer(open_.decompress(r.counts), "<u4")
        x[i] /= max(1, x[i].sum())
    return Machines(languages, x, np.array([languages.index(r.lang) for r in packs], int))


def _predict(model, carried: list[str]):
    def run(batches):
        m: Machines = model.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column("_t")):
                n = b - a
                cell, at = trigrams(data, offsets)
                lang, score = np.full(n, len(m.languages)), np.zeros(n)
                rows = np.flatnonzero(has_letter(data, offsets)) if m.languages else np.zeros(0, int)
                if len(rows):
                    margins = np.empty((n, m.weights.shape[1]))
                    for j in range(m.weights.shape[1]):
                        total = np.concatenate([[0], np.cumsum(m.weights[:, j][cell], dtype=np.float64)])
                        margins[:, j] = (total[at[1:]] - total[at[:-1]]) / np.maximum(1, at[1:] - at[:-1]) + m.bias[j]
                    lang[rows], score[rows] = m.predict(margins[rows])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, n) for c in carried), pa.array(names[lang], pa.string()), pa.array(score)], [*carried, "lang_pred", "score"])

    return K.tidy(run)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; held-out rows are not learned from. With ``carry``, these columns
    of docs in place of doc_id and held_out.

    lang_pred is a learned label, or ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learned. With one language only, that one is predicted. A null id is not held out. Repeated rows are kept; other columns
    are not read. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out(key) & F.col(key).isNotNull(), text, lang, key, per_language))
    K.give_back()  # the sample's
    first = list(carry) or ["doc_id", "held_out"]
    rows = docs.select(*([F.col(c) for c in carry] or [F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out")]), F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_t").dtypes)
    return rows.mapInArrow(_predict(model, first), f"{schema}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
