"""Audits of documents against artifacts: references, their kinds, formatted values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HREF = r"href=[\"']([^\"'#\s>]+)"
TICKED = r"`([A-Za-z0-9_.{},*/-]+/[A-Za-z0-9_.{},*/-]*)`"


def references(docs: DataFrame, key: str, text: str, pattern: str = HREF) -> DataFrame:
    """key, ref: the distinct references of each document."""
    return docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("ref"))


def kind(ref: Column) -> Column:
    return (
        F.when(ref.rlike("^[a-z]+:"), "external")
        .when(ref.contains("*"), "glob")
        .when(ref.contains("{"), "braces")
        .when(ref.endswith("/"), "directory")
        .when(ref.rlike(r"\.[A-Za-z0-9]{1,5}$"), "file")
        .otherwise("bare")
    )


def expanded(s: str) -> list[str]:
    """All strings that groups in braces stand for; groups may be nested."""
    depth, start, cuts = 0, -1, []
    for i, c in enumerate(s):
        if c == "{":
            depth += 1
            if depth == 1:
                start, cuts = i, [i]
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                cuts.append(i)
                tails = expanded(s[i + 1 :])
                inner = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in expanded(s[a + 1 : b])]
                return [s[:start] + x + t for x in inner for t in tails]
    return [s]


def expand_braces(refs: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: None if s is None else expanded(s))

    return run(refs)


def glob_pattern(ref: Column) -> Column:
    """A regular expression for a reference in which * stands for any run without a slash."""
    quoted = F.regexp_replace(ref, r"([.+?()\[\]{}^$|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("$"))


def resolved(refs: DataFrame, paths: DataFrame, extensions: list[str]) -> DataFrame:
    """refs with status: exact, glob, extension (the first that fits) or missing. paths: a column ``path``.

    Exact matches and those with an extension are equi-joins. Globs meet only paths of their own first directory.
    """
    known = paths.select("path").distinct()
    exact = refs.join(known.withColumnRenamed("path", "ref").withColumn("_e", F.lit(True)), "ref", "left")
    tries = refs.select("ref").distinct().select("ref", F.posexplode(F.array(*[F.concat("ref", F.lit(x)) for x in extensions])).alias("i", "path"))
    by_ext = tries.join(known, "path").groupBy("ref").agg(F.min_by("path", "i").alias("_x"))
    globs = refs.where(F.col("ref").contains("*")).select("ref").distinct().withColumn("_t", F.regexp_extract("ref", r"^([^/*]*/)?", 0))
    by_glob = globs.join(known.withColumn("_t", F.regexp_extract("path", r"^([^/*]*/)?", 0)), "_t").where(F.regexp_like(F.col("path"), glob_pattern(F.col("ref")))).groupBy("ref").agg(F.count("*").alias("_g"))
    both = exact.join(by_ext, "ref", "left").join(by_glob, "ref", "left")
    status = F.when(F.col("_e"), "exact").when(F.col("_g") > 0, "glob").when(F.col("_x").isNotNull(), "extension").otherwise("missing")
    return both.withColumn("status", status).drop("_e", "_x", "_g")


def status_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("kind", "status").agg(F.count("*").alias("n"))


def invocations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, script: scripts that a document's lines run; lines that a backslash continues are joined first."""
    lines = F.split(F.regexp_replace(text, r"\\\n", " "), "\n")
    script = F.regexp_extract("line", r"(?:^|\s)python3?\s+(?:-m\s+)?([A-Za-z0-9_./-]+)", 1)
    return docs.select(key, F.explode(lines).alias("line")).select(key, script.alias("script")).where("script <> ''")


def drift(claims: DataFrame, value: Column, text: Column, digits: int = 4) -> DataFrame:
    """claims with ok: is the value, with so many digits, a number of the text?"""
    shown = F.format_string(f"%.{digits}f", value)
    return claims.withColumn("shown", shown).withColumn("ok", F.array_contains(F.regexp_extract_all(text, F.lit(r"-?[0-9]+\.[0-9]+"), F.lit(0)), F.col("shown")))


def line_drifts(claims: DataFrame, docs: DataFrame, doc: str = "doc", digits: int = 4) -> DataFrame:
    """artifact, doc, line_no (from 1), fault of lines that give an artifact's value and contradict it: another step right
    behind it (``@ N``), or a cell of 0.0 although the artifact's change is not 0.

    claims: artifact, doc, value, step, change, one row for each artifact and document. Lines that have the value more than
    once are summaries of several runs and are passed over, as are documents that are not there.
    """
    lines = docs.select(doc, F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    both = claims.withColumn("_v", F.format_string(f"%.{digits}f", "value")).join(lines, doc)
    times = (F.char_length("line") - F.char_length(F.replace("line", F.col("_v")))) / F.char_length("_v")
    stated = F.regexp_extract(F.expr("substring_index(line, _v, -1)"), r"^\s*@\s*([0-9]+)", 1)
    step = F.when((stated != "") & (stated.cast("long") != F.col("step")), "step")
    change = F.when((F.col("change") != 0) & F.col("line").rlike(r"\|\s*0\.0\s*\|"), "change")
    return both.where(times == 1).select("artifact", doc, (F.col("line_no") + 1).cast("long").alias("line_no"), F.explode(F.array_compact(F.array(step, change))).alias("fault"))


def plain_path(path: Column) -> Column:
    """Without quotes, line-end marks and backslashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"^[\"']|[\"']$|\\r$", ""), r"\\", "/")


def included(docs: DataFrame, path: str, prefixes: tuple[str, ...]) -> DataFrame:
    """docs whose path begins with none of the prefixes."""
    for p in prefixes:
        docs = docs.where(~F.col(path).startswith(p))
    return docs
