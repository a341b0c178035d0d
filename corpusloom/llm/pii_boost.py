"""Operator 5 [native]: personal data by candidate gradient boosting.

Method. Fixed rules find e-mail addresses, IP addresses, card and phone numbers. Beside them, generators of high recall
propose further spans (strings that may be secrets, groups of digits that may be personal numbers, addresses in words),
which may overlap. Boosted trees on format features and on words in front of a candidate score it; the score is calibrated
on rows that the trees have not seen, and a threshold for each generator is set for a wanted precision there. Of
overlapping candidates the best stays; the rules' own spans always stay.

Training. The trees learn from EXAMPLES labelled snippets that are written from a seed, never from documents. Snippets go
through the same expressions as documents. The trees become one SQL expression.

Scale. One projection over documents, built-in functions only: no shuffle, no Python on executors, nothing gathered. Regular
expressions are anchored at the begin of runs and possessive, so long texts take linear time. Offsets are summed in blocks
of 256 matches.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 2400
PRECISION = 0.97
_B = 256

_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
    "number": r"(?<![0-9A-Za-z.,/-])\(?[0-9]{2,4}+(?:\)?[ ./-][0-9]{2,7}+){1,4}+",
    "handle": rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]++ ?[(\[]?(?<![A-Za-z])at(?![A-Za-z])[)\]]? ?[A-Za-z0-9-]++ ?[(\[]?(?<![A-Za-z])dot(?![A-Za-z])[)\]]? ?[A-Za-z]{{2,}}+",
}
#: Cheap conditions without which there is no match.
_MAY = {
    "email": "contains({t}, '@')",
    "ip": "rlike({t}, '[0-9]\\\\.[0-9]')",
    "card": "rlike({t}, '[0-9](?:[\\\\x20-]?[0-9]){{11}}')",
    "phone": "contains({t}, '+')",
    "secret": "rlike({t}, '[0-9]')",
    "number": "rlike({t}, '[0-9][0-9]')",
    "handle": "contains({t}, 'dot')",
}
_OK = {
    "email": "true",
    "ip": "forall(split(c.match, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 and cast(right(p, 3) as int) <= 255)",
    "card": "length(translate(c.match, ' -', '')) between 12 and 19 and aggregate(transform(split(reverse(translate(c.match, ' -', '')), ''), (d, i) -> if(d = '', 0, if(i % 2 = 0, cast(d as int), cast(d as int) * 2 div 10 + cast(d as int) * 2 % 10))), 0L, (a, d) -> a + d) % 10 = 0",
    "phone": "length(regexp_replace(c.match, '[^0-9]', '')) between 9 and 15",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(df: DataFrame, kinds) -> DataFrame:
    """Adds _s_<kind>: all matches of the kind's pattern in _t, as (start, end, match), in code points."""
    for step in range(5):
        new = {}
        for k in kinds:
            may, pat = _MAY[k].format(t="_t"), _quoted(_PATTERNS[k])
            new |= (
                {f"_m_{k}": f"if({may}, regexp_extract_all(_t, {pat}, 0), array())"},
                {f"_g_{k}": f"if(size(_m_{k}) > 0, transform(split(_t, {pat}, -1), x -> length(x)), array())"},
                {f"_u_{k}": f"zip_with(slice(_g_{k}, 1, size(_m_{k})), _m_{k}, (a, b) -> a + length(b))"},
                {f"_c_{k}": f"transform(sequence(0, size(_u_{k}) div {_B}), q -> aggregate(slice(_u_{k}, 1, q * {_B}), 0, (a, b) -> a + b))"},
                {
                    f"_s_{k}": f"transform(_m_{k}, (x, i) -> named_struct('start', if(size(_c_{k}) > 0, get(_c_{k}, i div {_B}), 0) + aggregate(slice(_u_{k}, i div {_B} * {_B} + 1, i % {_B}), 0, (a, b) -> a + b) + get(_g_{k}, i), 'match', x))"
                },
            )[step]
        df = df.withColumns({a: F.expr(b) for a, b in new.items()})
    return df.drop(*[f"_{p}_{k}" for p in "mguc" for k in kinds])


WORDS = {
    "secret": "token|secret|passw|pwd|bearer|auth|api|credential|private",
    "number": "ssn|social|phone|tel|call|mobile|fax|account|acct|iban|passport|tax|patient|member",
    "handle": "mail|contact|write|reach|address",
}
_KIND_NO = {"secret": 0, "number": 1, "handle": 2}
#: x: the match; l: the text in front of it, in lower case.
FEATURES = {
    "kind": "cast(k as double)",
    "length": "cast(length(x) as double)",
    "digits": "cast(length(regexp_replace(x, '[^0-9]', '')) as double)",
    "upper": "cast(length(regexp_replace(x, '[^A-Z]', '')) as double)",
    "lower": "cast(length(regexp_replace(x, '[^a-z]', '')) as double)",
    "other": "cast(length(regexp_replace(x, '[A-Za-z0-9]', '')) as double)",
    "distinct": "cast(size(array_distinct(split(x, ''))) as double)",
    "hex": "if(rlike(x, '^[0-9a-f]+$'), 1D, 0D)",
    "ssn": "if(rlike(x, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'), 1D, 0D)",
    "local": "if(rlike(x, '^\\\\(?[0-9]{3}\\\\)?[ .-][0-9]{3}[ .-][0-9]{4}$'), 1D, 0D)",
    "date": "if(rlike(x, '^(?:[12][0-9]{3}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][01]?[0-9][-./ ][12][0-9]{3})$'), 1D, 0D)",
    "dash": "cast(length(x) - length(replace(x, '-', '')) as double)",
    "near_secret": f"if(rlike(l, '{WORDS['secret']}'), 1D, 0D)",
    "near_number": f"if(rlike(l, '{WORDS['number']}'), 1D, 0D)",
    "near_handle": f"if(rlike(l, '{WORDS['handle']}'), 1D, 0D)",
    "assigned": "if(rlike(l, '[=:][ \"]*$'), 1D, 0D)",
}
_FRONT = 32


def _with_features(kind: str, body: str) -> str:
    """SQL: the candidates of _s_<kind> with x, l and k filled in ``body`` (an expression over them)."""
    front = f"lower(substring(_t, greatest(c.start - {_FRONT}, 0) + 1, least(c.start, {_FRONT})))"
    return f"transform(_s_{kind}, c -> element_at(transform(array(named_struct('x', c.match, 'l', {front}, 'k', {_KIND_NO[kind]})), f -> {body}), 1))"


def _bound(expression: str) -> str:
    import re

    return re.sub(r"(?<![\w'.])([xlk])(?=[,) ])", r"f.\1", expression)


def _snippets(seed: int = 7) -> list[tuple[str, int]]:
    """(text, 1 if it holds personal data or a secret): a third of each generator's kind, half of them negative."""
    rng = random.Random(seed)
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("etaoinshrdlcumwfgypbvk", k=rng.randrange(2, 10)))
    pick = rng.choice
    prose = lambda: " ".join(word() for _ in range(rng.randrange(2, 8)))
    made = []
    for i in range(EXAMPLES):
        good, kind = i % 2, i // 2 % 3
        if kind == 0:
            lead = pick(["token = \"", "api_key: ", "secret=", "password: ", "Authorization: Bearer ", "private key ", ""]) if good else pick(["see section ", "build ", "file ", "the ", "page "])
            body = pick([hexed(pick([32, 40, 64])), mixed(pick([20, 24, 32, 40])), "sk-" + mixed(32), "AKIA" + mixed(16).upper()]) if good else pick([word() + "-" + word() + "-" + word() + "-" + digits(2) + word(), "chapter" + digits(1) + "-" + word() + word() + word(), word() + word() + word() + word()[:3] + digits(1), "-" * 18 + digits(2), digits(4) + "-" + word() + "-" + word() + "-" + word()])
        elif kind == 1:
            lead = pick(["SSN ", "call ", "tel: ", "phone ", "passport no ", "account ", "social security ", ""]) if good else pick(["on ", "version ", "pages ", "from ", "since ", "ratio ", "in "])
            body = pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]) if good else pick([f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"{rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.{rng.randrange(1900, 2030)}", f"{rng.randrange(10, 99)}-{rng.randrange(100, 999)}", f"{rng.randrange(1900, 1990)}-{rng.randrange(1990, 2030)}", f"{rng.randrange(10, 99)}.{digits(2)}", f"{digits(2)} {digits(3)} {digits(2)}"])
        else:
            lead = pick(["mail me at ", "contact: ", "write to ", "address ", ""]) if good else pick(["look ", "we met ", "it is "])
            body = pick([f"{word()} (at) {word()} (dot) com", f"{word()}.{word()} [at] {word()} [dot] org", f"{word()} at {word()} dot net"]) if good else pick([f"{word()} at {word()} dot {word()}", f"{word()} at the dot {word()}"])
        made.append((f"{prose()} {lead}{body}{pick(['', ' ', '. ', ', '])}{prose() if rng.random() < 0.9 else ''}", good))
    return made


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """A regression tree on gradients: (feature, threshold, below or equal, above), or a leaf's value."""
    if depth == 0 or len(g) < 8:
        return float(-g.sum() / (h.sum() + 1.0)) if len(g) else 0.0
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for v in (values[:-1] + values[1:]) / 2 if len(values) < 24 else np.quantile(x[:, j], np.arange(1, 16) / 16):
            low = x[:, j] <= v
            if 4 <= low.sum() <= len(g) - 4:
                gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, j, float(v))
    if best[1] is None:
        return float(-g.sum() / (h.sum() + 1.0))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, v, a, b = tree
    return np.where(x[:, j] <= v, _apply(a, x), _apply(b, x))


class Boosted:
    """Boosted trees with a logistic loss, a calibration line, and a threshold on the score for each generator."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4):
        fit = np.arange(len(x)) % 4 != 0
        self.rate, self.trees = rate, []
        score = np.zeros(len(x))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score[fit]))
            self.trees.append(_tree(x[fit], p - y[fit], p * (1 - p), depth))
            score = score + rate * _apply(self.trees[-1], x)
        self.score = score
        s, t = score[~fit], y[~fit]
        a, b = 1.0, 0.0
        for _ in range(200):  # the calibration line, by gradient steps
            d = 1 / (1 + np.exp(-(a * s + b))) - t
            a, b = a - 0.05 * (d * s).mean(), b - 0.2 * d.mean()
        self.line = (a, b)
        self.thresholds = []
        for k in range(len(_KIND_NO)):
            mine = x[~fit][:, 0] == k
            chance = 1 / (1 + np.exp(-(a * s[mine] + b)))
            levels = [v for v in np.arange(0.5, 0.96, 0.05) if (chance >= v).any() and t[mine][chance >= v].mean() >= PRECISION]
            self.thresholds.append(float(min(levels, default=0.95)))

    def sql(self) -> str:
        """The calibrated chance, as SQL over an array v of features."""

        def node(t) -> str:
            return f"{float(t)!r}D" if isinstance(t, float) else f"if(v[{t[0]}] <= {float(t[1])!r}D, {node(t[2])}, {node(t[3])})"

        a, b = map(float, self.line)
        return f"1D / (1D + exp(-({a!r}D * {self.rate!r}D * ({' + '.join(map(node, self.trees))}) + {b!r}D)))"


_VECTOR = "array(" + ", ".join(_bound(x) for x in FEATURES.values()) + ")"


@lru_cache(maxsize=4)
def _trained(spark: SparkSession) -> Boosted:
    texts = _snippets()
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, _t string")
    rows = _located(rows, _KIND_NO)
    for k in _KIND_NO:
        rows = rows.withColumn(f"_v_{k}", F.expr(_with_features(k, _VECTOR)))
    got = rows.select("i", F.expr("concat(" + ", ".join(f"_v_{k}" for k in _KIND_NO) + ")").alias("v")).select("i", F.explode("v").alias("v")).orderBy("i", "v").collect()
    return Boosted(np.array([r.v for r in got]), np.array([texts[r.i][1] for r in got], float))


def find_personal_data(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with base and spans: arrays of (start, end, kind, no, chance), sorted; start and end in code points of the text,
    end exclusive. base: what the rules find; spans: base and the selected candidates.

    docs needs text; other columns stay, but for ``base`` and ``spans``. Null and empty texts have no spans. Repeated rows
    are kept. An empty table gives an empty result. no: the rank of the kind among equal starts.
    """
    model = model or _trained(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("base", "spans")]
    df = _located(docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")), [*KINDS, *_KIND_NO])
    item = "named_struct('start', c.start, 'no', {no}, 'end', c.start + length(c.match), 'kind', '{kind}', 'chance', {chance})"
    base = [f"transform(filter(_s_{k}, c -> {_OK[k]}), c -> {item.format(no=i, kind=k, chance='1D')})" for i, k in enumerate(KINDS)]
    df = df.withColumn("base", F.expr(f"array_sort(concat({', '.join(base)}))"))
    chance = f"element_at(transform(array({_VECTOR}), v -> {model.sql()}), 1)"
    df = df.withColumns({f"_p_{k}": F.expr(f"if(size(_s_{k}) > 0, {_with_features(k, chance)}, array())") for k in _KIND_NO})
    more = [f"filter(zip_with(_s_{k}, _p_{k}, (c, p) -> {item.format(no=len(KINDS) + i, kind=k, chance='p')}), c -> c.chance >= {model.thresholds[i]!r}D)" for k, i in _KIND_NO.items()]
    df = df.withColumn("_x", F.expr(f"array_sort(concat(base, {', '.join(more)}))"))
    # of overlapping spans the better stays: rules first, then chance, then place; spans that overlap stand near each other
    better = "o.end > c.start and o.start < c.end and o <> c and (o.no < 4 or o.chance > c.chance or (o.chance = c.chance and (o.start, o.no) < (c.start, c.no)))"
    better = better.replace("(o.start, o.no) < (c.start, c.no)", "named_struct('s', o.start, 'n', o.no) < named_struct('s', c.start, 'n', c.no)")
    df = df.withColumn("spans", F.expr(f"filter(_x, (c, i) -> c.no < 4 or not exists(slice(_x, greatest(i - 16, 0) + 1, 33), o -> {better}))"))
    return df.select(*names, "base", "spans")


def redact(found: DataFrame) -> DataFrame:
    """The same rows with each span of the text replaced by its kind in brackets; of overlapping spans the first counts."""
    first = F.expr("filter(spans, (c, i) -> i = 0 or not exists(slice(spans, greatest(i - 16, 0) + 1, least(i, 16)), o -> o.end > c.start))")
    df = found.withColumn("_f", first)
    parts = "transform(sequence(0, size(_f)), i -> concat(substring(text, if(i = 0, 0, get(_f, i - 1).end) + 1, if(i = size(_f), length(text), get(_f, i).start) - if(i = 0, 0, get(_f, i - 1).end)), if(i = size(_f), '', concat('[', get(_f, i).kind, ']'))))"
    return df.withColumn("text", F.expr(f"if(text is null or size(_f) = 0, text, array_join({parts}, ''))")).drop("_f")


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = "array_join(transform({}, c -> concat_ws(':', c.kind, c.start, c.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, c -> c.no = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
