"""Reconciling references in documents with a tree of paths: kinds, braces, globs, directories, scripts, status.

The tree is a table of its nodes (a trie by path segments). Patterns walk it segment by segment, each step a join on the parent
directory, so a pattern meets only the nodes of the directories that it has reached; it begins at its longest prefix without a
wildcard. Where a segment begins with HEAD plain characters, these are part of the join key too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 3
#: What a reference looks like, suffixes that may be left out, endings of unfinished names. A script is any path to
#: a Python file in a folder.
REFERENCE = r"artifacts/[A-Za-z0-9_./\-*{}<>,=]+"
INVOCATION = r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.py)\b"
EXTENSIONS = (".json", ".png", ".md", ".txt", ".csv", ".yaml", ".pt", ".ckpt", ".safetensors", ".bin")
UNFINISHED = ("-", "_", "...")


def braces(ref: Column) -> Column:
    """All strings that a reference with groups in braces stands for, inner groups first; groups may be nested."""

    def one(s: Column) -> Column:
        group = F.regexp_extract(s, r"\{[^{}]*\}", 0)
        at = F.position(group, s)
        before = F.substring(s, F.lit(1), at - 1)
        after = F.substring(s, at + F.char_length(group), F.char_length(s))
        inner = F.split(F.substring(group, F.lit(2), F.char_length(group) - 2), ",")
        return F.when(group == "", F.array(s)).otherwise(F.transform(inner, lambda x: F.concat(before, x, after)))

    # a pass for each opening brace
    passes = F.sequence(F.lit(0), F.char_length(F.regexp_replace(ref, r"[^{]", "")))
    return F.aggregate(passes, F.array(ref), lambda all_, _: F.flatten(F.transform(all_, one)))


def tree(paths: DataFrame) -> DataFrame:
    """path, parent, segment, is_dir: all files of a column ``path`` and the directories above them, once each."""
    parts = F.split("path", "/")
    cut = paths.select("path").distinct().select(parts.alias("s"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    join = lambda n: F.array_join(F.slice("s", F.lit(1), n), "/")
    nodes = cut.select(join(F.col("i")).alias("path"), join(F.col("i") - 1).alias("parent"), F.element_at("s", F.col("i")).alias("segment"), (F.col("i") < F.size("s")).alias("is_dir"))
    return nodes.groupBy("path", "parent", "segment").agg(F.max("is_dir").alias("is_dir"))


def segment_pattern(segment: Column) -> Column:
    """A regular expression for one segment, in which * stands for any run."""
    quoted = F.regexp_replace(segment, r"([.+?()\[\]{}^$|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.lit("$"))


def _descended(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every directory at or below each reached one, and if it is the last segment every file: the step of a segment **."""
    above = F.transform(F.sequence(F.lit(0), F.size("p")), lambda k: F.array_join(F.slice(F.col("p"), F.lit(1), k), "/"))
    inside = nodes.select("path", "is_dir", F.split("path", "/").alias("p")).select("path", "is_dir", F.explode(above).alias("node")).where("is_dir or node <> path")
    moved = at.join(inside, "node").where("is_dir or last").select("to", "last", F.col("path").alias("node"), "is_dir")
    return moved.union(at.where("node = ''").select("to", "last", "node", F.lit(True).alias("is_dir")))


def globbed(patterns: DataFrame, nodes: DataFrame) -> DataFrame:
    """pattern, path, is_dir: the nodes that each pattern (a column ``pattern``) matches. A segment ** is any number of
    directories. The number of steps is that of segments in the longest pattern. What patterns begin with is walked once for
    all patterns that begin alike, so what is kept of a step is a row for each beginning and directory, not for each pattern."""
    parts = F.split("pattern", "/")
    plain = F.regexp_extract("pattern", r"^((?:[^*/]+/)*)", 1)
    known = patterns.select("pattern").distinct().select("pattern", parts.alias("s"), F.rtrim(plain, F.lit("/")).alias("node"), (F.size(F.split(plain, "/")) - 1).alias("i"))
    first, end, deep = known.agg(F.coalesce(F.min("i"), F.lit(0)), F.coalesce(F.max(F.size("s")), F.lit(0)), F.coalesce(F.max(F.array_contains("s", "**")), F.lit(False))).first()
    begins = known.select(F.col("node").alias("prefix"), "node", "i")
    head = lambda n: F.array_join(F.slice("s", F.lit(1), n), "/")
    steps = known.select("s", F.explode(F.sequence("i", F.size("s") - 1)).alias("i"))
    steps = steps.select("i", head(F.col("i")).alias("prefix"), head(F.col("i") + 1).alias("to"), F.get("s", "i").alias("want"), (F.col("i") + 1 == F.size("s")).alias("last"))
    steps = steps.groupBy("i", "prefix", "to", "want").agg(F.max("last").alias("last"))
    begin_of_want = F.left(F.regexp_extract("want", r"^[^*]*", 0), F.lit(HEAD))
    steps = steps.withColumn("head", F.when(F.char_length(begin_of_want) == HEAD, begin_of_want).otherwise(""))
    below = nodes.select(F.col("parent").alias("node"), F.col("path").alias("found"), "segment", "is_dir", F.explode(F.array_distinct(F.array(F.lit(""), F.left("segment", F.lit(HEAD))))).alias("head"))
    done = moved = None
    for i in range(first, end):
        at = begins.where(F.col("i") == i).drop("i")
        if moved is not None:
            at = at.union(moved.where("is_dir").select(F.col("to").alias("prefix"), "node"))
        at = at.distinct().join(steps.where(F.col("i") == i), "prefix")
        hits = at.where("want <> '**'").join(below, ["node", "head"]).where("is_dir or last")
        hits = hits.where(F.when(F.col("want").contains("*"), F.regexp_like(F.col("segment"), segment_pattern(F.col("want")))).otherwise(F.col("segment") == F.col("want")))
        moved = hits.select("to", "last", F.col("found").alias("node"), "is_dir")
        if deep:
            moved = moved.union(_descended(at.where("want = '**'"), nodes))
        ended = moved.where("last and node <> ''").select(F.col("to").alias("pattern"), F.col("node").alias("path"), "is_dir")
        done = ended if done is None else done.union(ended)
    empty = patterns.select("pattern", F.lit("").alias("path"), F.lit(False).alias("is_dir")).where("false")
    return empty if done is None else done.distinct()


def references(docs: DataFrame, key: str, text: str = "text", pattern: str = REFERENCE, invocation: str = INVOCATION) -> DataFrame:
    """key, ref, script: the distinct references of each document, and the script of the first line (joined where a backslash
    continues it) that runs one and names the reference or its directory."""
    lines = F.split(F.regexp_replace(text, r"\\+[ \t]*\r?\n", " "), r"\r\n|\n|\r")
    calls = F.filter(F.transform(lines, lambda x: F.named_struct(F.lit("line"), x, F.lit("script"), F.regexp_extract(x, invocation, 1))), lambda x: x.script != "")
    rows = docs.select(key, calls.alias("_calls"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("ref"))
    bare = F.rtrim(F.col("ref"), F.lit("/"))
    folder = F.when(bare.contains("/"), F.regexp_replace(bare, r"/[^/]*$", "")).otherwise(bare)
    named = F.filter("_calls", lambda x: x.line.contains(F.col("ref")) | x.line.contains(folder))
    return rows.select(key, "ref", F.try_element_at(named, F.lit(1)).script.alias("script"))


def reconciled(refs: DataFrame, paths: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """refs (with ref and script) with kind, n_matches, match (the least path, or the first extension's) and status.

    Kinds: placeholder (unfinished, or with <...>), directory (a / at the end, or one is there), glob_pattern, exact_file.
    Status: PLACEHOLDER, FOUND, MISSING_RESOLVABLE (its script is there) or MISSING_UNRESOLVABLE. A directory is found if any
    of its expansions is one, a glob if any of its expansions is or matches a file, a file also with an extension added.
    """
    nodes = tree(paths)
    known = refs.select("ref").distinct()
    ends = [F.col("ref").endswith(x) for x in UNFINISHED]
    unfinished = ends[0] | ends[1] | ends[2] | (F.col("ref").contains("<") & F.col("ref").contains(">"))
    tries = known.where(~unfinished).select("ref", F.explode(braces(F.col("ref"))).alias("cand")).select("ref", F.rtrim(F.col("cand"), F.lit("/")).alias("cand")).distinct()
    wild = F.col("cand").contains("*")
    literal = tries.where(~wild).join(nodes.select(F.col("path").alias("cand"), "is_dir"), "cand").select("ref", F.col("cand").alias("path"), "is_dir", F.lit(True).alias("plain"))
    by_glob = tries.where(wild).join(globbed(tries.where(wild).select(F.col("cand").alias("pattern")), nodes).withColumnRenamed("pattern", "cand"), "cand").select("ref", "path", "is_dir", F.lit(False).alias("plain"))
    longer = known.where(~unfinished & ~F.col("ref").rlike("[*{]")).select("ref", F.posexplode(F.array(*[F.concat("ref", F.lit(x)) for x in extensions])).alias("i", "path"))
    by_end = longer.join(nodes.where("not is_dir").select("path"), "path").groupBy("ref").agg(F.min_by("path", "i").alias("longer"))
    found = literal.union(by_glob).groupBy("ref", "path", "is_dir").agg(F.max("plain").alias("plain")).groupBy("ref").agg(
        F.max(F.col("plain") & F.col("is_dir")).alias("dir_there"),
        F.count_if("is_dir").alias("n_dirs"),
        F.min(F.when(F.col("is_dir"), F.col("path"))).alias("dir"),
        F.count_if(~F.col("is_dir")).alias("n_files"),
        F.min(F.when(~F.col("is_dir"), F.col("path"))).alias("file"),
    )
    both = known.join(found, "ref", "left").join(by_end, "ref", "left")
    kind = F.when(unfinished, "placeholder").when(F.col("ref").endswith("/") | F.coalesce("dir_there", F.lit(False)), "directory").when(F.col("ref").rlike("[*{]"), "glob_pattern").otherwise("exact_file")
    both = both.withColumn("kind", kind)
    is_dir, exact = F.col("kind") == "directory", F.col("kind") == "exact_file"
    n = F.when(F.col("kind") == "placeholder", 0).when(is_dir, F.coalesce("n_dirs", F.lit(0))).otherwise(F.coalesce("n_files", F.lit(0)))
    match = F.when(F.col("kind") == "placeholder", F.lit(None)).when(is_dir, F.col("dir")).otherwise(F.col("file"))
    both = both.select("ref", "kind", F.when(exact & (n == 0) & F.col("longer").isNotNull(), 1).otherwise(n).cast("long").alias("n_matches"), F.when(exact, F.coalesce(match, "longer")).otherwise(match).alias("match"))
    scripts = nodes.select(F.col("path").alias("script"), F.lit(True).alias("_runs"))
    status = F.when(F.col("kind") == "placeholder", "PLACEHOLDER").when(F.col("n_matches") > 0, "FOUND").when(F.col("_runs"), "MISSING_RESOLVABLE").otherwise("MISSING_UNRESOLVABLE")
    return refs.join(both, "ref").join(scripts, "script", "left").withColumn("status", status).drop("_runs")


KINDS = ("placeholder", "directory", "glob_pattern", "exact_file")
STATUSES = ("PLACEHOLDER", "FOUND", "MISSING_RESOLVABLE", "MISSING_UNRESOLVABLE")


def status_pivot(found: DataFrame) -> DataFrame:
    """kind, total and a count for each status: a row for each kind that occurs."""
    return found.groupBy("kind").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
