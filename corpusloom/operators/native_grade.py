"""The eight layers by built-in functions, where samples and transcripts are columns: no Python, no shuffle.

``tools.grade_transcript`` grades JSON documents of any form; this one takes calls as arrays, and tools whose schemas are known
to the driver, and gives the same layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gate import compiled
from .transcript import canonical

WANTED = "array<struct<call_id: string, name: string, arguments: string, depends_on: array<string>, expected_result: string>>"
ISSUED = "array<struct<call_id: string, name: string, arguments: string, depends_on: array<string>, result: string, outcome: string>>"


def _sorted(calls: Column, one) -> Column:
    return F.array_sort(F.transform(calls, one))


def _schema_layer(calls: Column, schemas: dict[str, dict]) -> Column:
    """Null if a call is of an unknown tool, before or after a bad one; false from the first bad call on."""
    checks = {name: compiled(s) for name, s in schemas.items()}

    def one(c: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for name, errors in checks.items():
            out = F.when(c["name"] == name, F.size(errors(F.coalesce(c["arguments"], F.lit("{}")))) == 0).otherwise(out)
        return F.named_struct(F.lit("known"), F.coalesce(c["name"].isin(*schemas), F.lit(False)), F.lit("fits"), out)

    found = F.transform(calls, one)
    bad = F.array_position(F.transform(found, lambda x: F.coalesce(~x["fits"], F.lit(False))), True)
    seen = F.when(bad > 0, F.slice(found, F.lit(1), bad.cast("int"))).otherwise(found)  # nothing behind the first bad call counts
    return F.when(F.exists(seen, lambda x: ~x["known"]), F.lit(None).cast("boolean")).otherwise(bad == 0)


def _plan_layer(wanted: Column, calls: Column) -> Column:
    same_deps = lambda a, b: F.array_sort(F.coalesce(a, F.array().cast("array<string>"))) == F.array_sort(F.coalesce(b, F.array().cast("array<string>")))

    def fits(w: Column, c: Column) -> Column:
        return w["name"].eqNullSafe(c["name"]) & w["call_id"].eqNullSafe(c["call_id"]) & canonical(w["arguments"]).eqNullSafe(canonical(c["arguments"])) & same_deps(w["depends_on"], c["depends_on"])

    each = F.forall(F.zip_with(wanted, calls, fits), lambda x: x)
    ids = F.transform(calls, lambda c: c["call_id"])
    early = F.transform(calls, lambda c, i: F.forall(F.coalesce(c["depends_on"], F.array().cast("array<string>")), lambda d: F.array_contains(F.slice(ids, F.lit(1), i), d)))
    return (F.size(wanted) == F.size(calls)) & each & F.forall(early, lambda x: F.coalesce(x, F.lit(False)))


def graded_layers(df: DataFrame, schemas: dict[str, dict], wanted: str = "expected_tool_calls", calls: str = "tool_calls", expected: str = "expected_answer", answer: str = "final_answer") -> DataFrame:
    """df with the eight layers. A null ``calls`` is a transcript that does not parse: the layers up to the answer's are null
    then. expected_result null: none is declared. Arguments are compared as JSON values; null ones count as no arguments for
    the schema."""
    w, c = F.coalesce(F.col(wanted), F.array().cast(WANTED)), F.col(calls)
    none = F.lit(None).cast("boolean")
    pair = lambda x: F.named_struct(F.lit("n"), x["name"], F.lit("a"), canonical(x["arguments"]))
    empty = F.when(F.size(w) == 0, F.lit(True)).otherwise(none)
    k = F.least(F.size(w), F.size(c))
    both = F.filter(F.zip_with(F.slice(w, F.lit(1), k), F.slice(c, F.lit(1), k), lambda a, b: F.named_struct(F.lit("said"), a["expected_result"].isNotNull(), F.lit("same"), a["expected_result"].eqNullSafe(b["result"]))), lambda x: x["said"])
    layers = {
        "schema_valid": _schema_layer(c, schemas),
        "tool_name_correct": _sorted(c, lambda x: x["name"]) == _sorted(w, lambda x: x["name"]),
        "argument_value_correct": _sorted(c, pair) == _sorted(w, pair),
        "call_plan_matches": _plan_layer(w, c),
        "execution_success": F.when(F.size(c) == 0, empty).otherwise(F.forall(c, lambda x: F.coalesce(x["outcome"] == "success", F.lit(False)))),
        "result_grounded": F.when(F.size(both) == 0, empty).otherwise(F.forall(both, lambda x: x["same"])),
    }
    out = {"parse_success": c.isNotNull()} | {n: F.when(c.isNotNull(), x) for n, x in layers.items()}
    out["final_answer_correct"] = F.contains(F.coalesce(F.col(answer), F.lit("")), F.col(expected))
    return df.withColumns(out)
