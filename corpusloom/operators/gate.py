"""The schema gate: JSON Schema compiled to column expressions over VARIANT, and writes that divide good rows from bad in one pass.

``compiled`` gives the same places and keywords as the interpreter ``rules.check``, with built-in functions only. A schema that
refers to itself has no finite expression and is an error here; the interpreter takes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import strict_json
from .rules import _IGNORED, _KNOWN

_MOMENT = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d([.,]\d+)?)?(Z|[+-]\d\d:?\d\d(:?\d\d)?)$"


def _none() -> Column:
    return F.array().cast("array<string>")


def _when(bad: Column, at: Column, keyword: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(at, F.lit(f": {keyword}")))).otherwise(_none())


def _text(v: Column) -> Column:
    """Canonical JSON of a variant: sorted keys, no spaces."""
    return F.to_json(v)


def _kinds(v: Column) -> dict[str, Column]:
    """Whether a variant is of each of JSON Schema's types."""
    form = F.schema_of_variant(v)
    number = form.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.try_variant_get(v, "$", "double")
    return {
        "object": form.startswith("OBJECT"),
        "array": form.startswith("ARRAY"),
        "string": form == "STRING",
        "boolean": form == "BOOLEAN",
        "null": form == "VOID",
        "number": number,
        "integer": number & (value == F.floor(value)),
    }


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _errors(schema: dict | bool, v: Column, at: Column, root: dict, open_: tuple[str, ...]) -> Column:
    if isinstance(schema, bool):
        return _none() if schema else F.array(F.concat(at, F.lit(": false")))
    if odd := schema.keys() - _KNOWN - _IGNORED:
        raise ValueError(f"keywords without a check: {sorted(odd)}")
    kind, out, first = _kinds(v), [], []
    if ref := schema.get("$ref"):
        if ref in open_:
            raise ValueError(f"a schema that refers to itself has no finite expression: {ref}")
        target = root
        for part in ref.removeprefix("#/").split("/"):
            target = target[part]
        first.append(_errors(target, v, at, root, (*open_, ref)))
    below = lambda s, x, place: _errors(s, x, place, root, open_)
    same = lambda value: _text(v) == F.lit(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    if "const" in schema:
        out.append(_when(~same(schema["const"]), at, "const"))
    if "enum" in schema:
        hit = F.lit(False)
        for x in schema["enum"]:
            hit = hit | same(x)
        out.append(_when(~hit, at, "enum"))
    number = F.try_variant_get(v, "$", "double")
    for k, bad in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m), ("exclusiveMinimum", lambda m: number <= m)):
        if k in schema:
            out.append(_when(kind["number"] & bad(F.lit(float(schema[k]))), at, k))
    text = F.try_variant_get(v, "$", "string")
    if schema.get("minLength"):
        out.append(_when(kind["string"] & (F.char_length(text) < schema["minLength"]), at, "minLength"))
    if "pattern" in schema:
        out.append(_when(kind["string"] & ~text.rlike(schema["pattern"]), at, "pattern"))
    if schema.get("format") == "date-time":
        moment = text.rlike(_MOMENT) & F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 16), "[t ]", "T")).isNotNull()
        out.append(_when(kind["string"] & ~moment, at, "format"))
    if {"minItems", "uniqueItems", "items", "contains"} & schema.keys():
        items, parts = F.try_variant_get(v, "$", "array<variant>"), []
        if schema.get("minItems"):
            parts.append(_when(F.size(items) < schema["minItems"], at, "minItems"))
        if schema.get("uniqueItems"):
            parts.append(_when(F.size(F.array_distinct(F.transform(items, _text))) < F.size(items), at, "uniqueItems"))
        if "items" in schema:
            parts.append(F.flatten(F.transform(items, lambda x, i: below(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
        if "contains" in schema:
            parts.append(_when(~F.exists(items, lambda x: F.size(below(schema["contains"], x, at)) == 0), at, "contains"))
        out.append(F.when(kind["array"], _joined(parts)).otherwise(_none()))
    known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    if known or schema.get("required") or more is not True or "propertyNames" in schema:
        fields, parts = F.try_variant_get(v, "$", "map<string,variant>"), []
        of = lambda k: F.concat(at, F.lit("."), k)
        parts += [_when(~F.map_contains_key(fields, k), of(F.lit(k)), "required") for k in schema.get("required", ())]
        parts += [F.when(F.map_contains_key(fields, k), below(s, fields[k], of(F.lit(k)))).otherwise(_none()) for k, s in known.items() if s is not True]
        if "propertyNames" in schema:
            bad = F.filter(F.map_keys(fields), lambda k: F.size(below(schema["propertyNames"], k.cast("variant"), at)) > 0)
            parts.append(F.transform(bad, lambda k: F.concat(of(k), F.lit(": propertyNames"))))
        if more is not True:
            rest = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*known)) if known else F.map_entries(fields)
            if more is False:
                parts.append(F.transform(rest, lambda e: F.concat(of(e["key"]), F.lit(": additionalProperties"))))
            else:
                parts.append(F.flatten(F.transform(rest, lambda e: below(more, e["value"], of(e["key"])))))
        if parts:
            out.append(F.when(kind["object"], _joined(parts)).otherwise(_none()))
    rest = _joined(out)
    if kinds := schema.get("type"):
        fits = F.lit(False)
        for k in [kinds] if isinstance(kinds, str) else kinds:
            fits = fits | kind[k]
        rest = F.when(F.coalesce(fits, F.lit(False)), rest).otherwise(F.array(F.concat(at, F.lit(": type"))))
    return F.concat(*first, rest) if first else rest


def compiled(schema: dict | bool) -> Callable[[Column], Column]:
    """A function from a JSON text column to its errors, an array of ``place: keyword``; ['$: json'] for what is no JSON."""

    root = schema if isinstance(schema, dict) else {}

    def run(text: Column) -> Column:
        # as the variable of a function the value is parsed once, however often the checks name it
        checked = F.transform(F.array(strict_json(text)), lambda v: F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(_errors(schema, v, F.lit("$"), root, ())))
        return F.get(checked, F.lit(0))

    return run


def gated_write(df: DataFrame, errors: Column, path: str, most_rejected: int | None = 0) -> dict[str, int]:
    """Writes df once, with its errors, as part=accepted and part=quarantine below path, and gives the counts.

    Counts are observed as rows are written. Beyond ``most_rejected`` bad rows (None: any number) nothing is published: the
    table appears by one rename, and path must not be there yet.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, staging = hadoop(path), hadoop(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    seen = Observation()
    rows = df.withColumn("errors", errors).observe(seen, F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("rejected"), F.max(F.when(F.size("errors") > 0, F.array_join("errors", ", "))).alias("sample"))
    try:
        rows.withColumn("part", F.when(F.size("errors") == 0, "accepted").otherwise("quarantine")).write.partitionBy("part").parquet(staging.toString())
        counts = seen.get
        if most_rejected is not None and counts["rejected"] > most_rejected:
            raise ValueError(f"{counts['rejected']} of {counts['n']} rows break the schema, such as: {counts['sample']}")
        if not files.rename(staging, target):
            raise OSError(f"{staging} could not be renamed")
    except BaseException:
        files.delete(staging, True)
        raise
    return {"accepted": counts["n"] - counts["rejected"], "quarantine": counts["rejected"]}


def with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (sample_id, name, arguments, expected_result, ...) with a missing expected_result filled from a table of what tools
    gave (name, arguments, result, of which arguments are compared as JSON values), and executable: is there a result at all?"""
    form = lambda c: F.coalesce(F.to_json(strict_json(F.col(c))), F.col(c))
    known = results.select(F.col("name").alias("_n"), form("arguments").alias("_a"), "result").groupBy("_n", "_a").agg(F.min("result").alias("_result"), F.lit(True).alias("_there"))
    keyed = calls.withColumn("_a", form("arguments"))
    both = keyed.join(known, (keyed["name"] == known["_n"]) & (keyed["_a"] == known["_a"]), "left")
    return both.withColumns({"expected_result": F.coalesce("expected_result", "_result"), "executable": F.coalesce("_there", F.lit(False))}).select(*calls.columns, "executable")


def sample_guards(samples: DataFrame, calls: DataFrame, key: str = "sample_id", class_: str = "class") -> DataFrame:
    """samples with errors: 'no_tool: calls' (a sample of that class calls something), 'calls: none' (one of another class does
    not), 'call: not executable' and 'call: no result'. calls are those of ``with_results``."""
    per = calls.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(~F.col("executable")).alias("_x"), F.count_if(F.col("executable") & F.col("expected_result").isNull()).alias("_r"))
    n = F.coalesce("_n", F.lit(0))
    found = F.array(
        F.when((F.col(class_) == "no_tool") & (n > 0), "no_tool: calls"),
        F.when((F.col(class_) != "no_tool") & (n == 0), "calls: none"),
        F.when(F.col("_x") > 0, "call: not executable"),
        F.when(F.col("_r") > 0, "call: no result"),
    )
    return samples.join(per, key, "left").withColumn("errors", F.array_compact(found)).drop("_n", "_x", "_r")
