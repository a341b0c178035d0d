"""Globs and braces against the file system's own, and every kind and status."""

from pathlib import Path

from pyspark.sql import functions as F

from corpusloom.operators import reconcile as R

FILES = ["artifacts/a/x.json", "artifacts/a/y.png", "artifacts/b/deep/x.json", "artifacts/b/deep/er/z.json", "artifacts/run-1/log.txt", "artifacts/run-22/log.txt", "artifacts/ru/l", "artifacts/bare", "artifacts/q+(1).json", "scripts/make.py"]
PATTERNS = ["artifacts/*", "artifacts/*/x.json", "artifacts/run-*/log.txt", "artifacts/r*/l*", "artifacts/**/x.json", "artifacts/**/*.json", "**/*.py", "artifacts/b/**", "*/*/*", "artifacts/q+(*).json", "artifacts/none/*", "*", "artifacts/a/x.json*", "artifacts/*u*/*"]


def test_globs(spark, tmp_path):
    for f in FILES:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("")
    paths = spark.createDataFrame([(f,) for f in [*FILES, FILES[0]]], "path string")
    got = R.globbed(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"), R.tree(paths)).collect()
    want = {(p, str(Path(m).relative_to(tmp_path)), m.is_dir()) for p in PATTERNS for m in tmp_path.glob(p)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert R.globbed(spark.createDataFrame([], "pattern string"), R.tree(paths)).collect() == []


def test_braces(spark):
    refs = {"a": ["a"], "a{b,c}": ["ab", "ac"], "{a,b}-{c,d}": ["a-c", "a-d", "b-c", "b-d"], "x{a,b{c,d}}": ["xa", "xbc", "xbd"], "{a": ["{a"], "{}": [""], "{a,a}{": ["a{", "a{"]}
    rows = spark.createDataFrame([(k,) for k in refs], "ref string").select("ref", R.braces(F.col("ref")).alias("x")).collect()
    assert {r.ref: sorted(set(r.x)) for r in rows} == {k: sorted(set(v)) for k, v in refs.items()}


def test_kinds_and_statuses(spark):
    text = """see artifacts/a/x.json, artifacts/a/y and `artifacts/gone.json`
python scripts/make.py --out \\
   artifacts/lost/f.json
python scripts/none.py > artifacts/away/f
artifacts/run- artifacts/<kind>.json artifacts/b/ artifacts/nodir/ artifacts/{a,b}
artifacts/run-*/ artifacts/{a,zz}/*.json artifacts/zz/*.json artifacts/bare"""
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc long, text string")
    paths = spark.createDataFrame([(f,) for f in FILES], "path string")
    found = R.reconciled(R.references(docs, "doc"), paths)
    got = {r.ref: (r.kind, r.status, r.n_matches, r.match) for r in found.collect()}
    assert got == {
        "artifacts/a/x.json,": ("exact_file", "MISSING_UNRESOLVABLE", 0, None),
        "artifacts/a/y": ("exact_file", "FOUND", 1, "artifacts/a/y.png"),
        "artifacts/gone.json": ("exact_file", "MISSING_RESOLVABLE", 0, None),
        "artifacts/lost/f.json": ("exact_file", "MISSING_RESOLVABLE", 0, None),
        "artifacts/away/f": ("exact_file", "MISSING_UNRESOLVABLE", 0, None),
        "artifacts/run-": ("placeholder", "PLACEHOLDER", 0, None),
        "artifacts/<kind>.json": ("placeholder", "PLACEHOLDER", 0, None),
        "artifacts/b/": ("directory", "FOUND", 1, "artifacts/b"),
        "artifacts/nodir/": ("directory", "MISSING_RESOLVABLE", 0, None),
        "artifacts/{a,b}": ("directory", "FOUND", 2, "artifacts/a"),
        "artifacts/run-*/": ("directory", "FOUND", 2, "artifacts/run-1"),
        "artifacts/{a,zz}/*.json": ("glob_pattern", "FOUND", 1, "artifacts/a/x.json"),
        "artifacts/zz/*.json": ("glob_pattern", "MISSING_UNRESOLVABLE", 0, None),
        "artifacts/bare": ("exact_file", "FOUND", 1, "artifacts/bare"),
    }
    pivot = {r.kind: r for r in R.status_pivot(found).collect()}
    assert pivot["directory"].found == 3 and pivot["directory"].missing_resolvable == 1 and pivot["exact_file"].total == 6


def test_patterns_that_begin_alike_are_walked_once(spark):
    nodes = R.tree(spark.createDataFrame([(f"artifacts/{h}/en/{n}.json",) for h in "abc" for n in range(30)], "path string"))
    found = R.globbed(spark.createDataFrame([(f"artifacts/*/en/{n}.j*",) for n in range(40)], "pattern string"), nodes)
    assert {r.n for r in found.groupBy("pattern").agg(F.count("*").alias("n")).collect()} == {3} and found.count() == 90
    keys = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "HashAggregate(keys=" in x and "prefix" in x]
    assert keys and not any("pattern#" in x or " s#" in x or "[s#" in x for x in keys)  # what is kept of a step is no row for each pattern
