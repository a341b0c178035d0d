"""Run contracts, chains, the sample store and the step sink on small cases."""

import glob
import json
import os

from pyspark.sql import functions as F

from corpusloom.operators import grade, runs
from corpusloom.sources import sample_store as S
from corpusloom.streaming import steps as sink


def test_chain_names_the_first_broken_link(spark):
    known = spark.createDataFrame([(x, x.upper()) for x in ("cache", "tok", "src", "a", "b")] + [("null", None)], "artifact string, sha256 string")
    says = [("r1", "cache", "CACHE"), ("r1", "tok", "TOK"), ("cache", "tok", "TOK"), ("cache", "src", "old"), ("tok", "src", "SRC"), ("r2", "lost", "x"), ("r3", "a", "A"), ("a", "b", "B"), ("b", "a", "A"), ("r4", "tok", "TOK"), ("r5", "null", "x")]
    roots = spark.createDataFrame([(f"r{i}",) for i in range(1, 7)], "artifact string")
    got = {r.root: tuple(r)[1:] for r in runs.binding_chain(known, spark.createDataFrame(says, "artifact string, bound_to string, sha256 string"), roots, 5).collect()}
    assert got == {"r1": (2, "cache", "src", "hash"), "r2": (1, "r2", "lost", "missing"), "r3": (5, "b", "a", "deep"), "r5": (1, "r5", "null", "missing")}


def test_a_right_run_breaks_nothing(spark):
    steps = spark.createDataFrame([(r, i, i + 1, 4, i == 3) for r in "ab" for i in range(4)], "run string, step long, samples_consumed long, max_steps long, completed boolean")
    expected = spark.createDataFrame([("a", 4), ("b", 4)], "run string, n_steps long")
    assert runs.counter_violations(steps, expected).collect() == []
    assert [tuple(r) for r in runs.islands(steps.where("run = 'a'")).collect()] == [("a", 0, 0, 3, 4)]
    late = steps.where("run = 'b' and step > 1")
    assert {(r.step, r.contract) for r in runs.counter_violations(late, expected.where("run = 'b'")).collect()} == {(2, "gap")}


def test_natural_updates(spark):
    kind = "run string, step long, rollouts array<struct<reward: double, advantage: double, n_calls: int, generated: string>>, skipped boolean, tokens_seen long, loss double, injected boolean"
    flat = [(0.5, 0.0, 1, "x")] * 3
    spread = [(0.0, -1.0, 0, "a"), (1.0, 1.0, 2, None)]
    rows = [("D", 0, spread, False, 5, 0.1, False), ("D", 1, flat, True, 0, 0.0, True), ("D", 2, [], False, 5, 0.1, False), ("A", 0, flat, True, 0, 0.0, True), ("A", 1, [(1.5, 0.1, 0, ""), (0.5, 0.1, 0, "")], False, 1, None, False)]
    got = {tuple(r) for r in runs.reward_violations(spark.createDataFrame(rows, kind), ["D"]).collect()}
    assert got == {("D", 1, c) for c in ("skipped", "tokens", "loss", "injected", "no_spread")} | {("D", 2, "no_spread"), ("A", 1, "reward_bounds"), ("A", 1, "advantage_mean")}
    figures = runs.step_figures(spark.createDataFrame(rows[:1], kind)).first()
    assert (figures.n_rollouts, figures.n_rewards, figures.advantage_std, figures.n_calls, figures.n_chars) == (2, 2, 1.0, 2, 1)


def test_summary_of_nothing(spark):
    none = grade.graded(spark.createDataFrame([], "parse_success boolean, task_type string"), ("parse_success",))
    assert [tuple(r) for r in grade.signal_summary(none, ("parse_success",)).collect()] == [("all", None, 0, None, None, None, None, None)]
    one = grade.graded(spark.createDataFrame([(True, None)], "parse_success boolean, task_type string"), ("parse_success",))
    assert {(r.of, r.value, r.n, r.binary_std) for r in grade.signal_summary(one, ("parse_success",)).collect()} == {("all", None, 1, 0.0), ("first_failure", "none", 1, 0.0), ("task_type", "unknown", 1, 0.0)}


def sample(i, source="made"):
    return json.dumps({"id": f"s{i}", "metadata": {"task_type": "t", "source": source}})


def state(path):
    return {f: (os.stat(f).st_mtime_ns, open(f).read()) for f in glob.glob(f"{path}/**/*.txt", recursive=True)}


def test_store_is_brought_up_to_date(spark, tmp_path):
    path = str(tmp_path / "store")
    wanted = spark.createDataFrame([("train" if i % 2 else "dev", f"s{i}", sample(i)) for i in range(40)], "split string, id string, body string")
    status = lambda df: sorted((r.id, r.status) for r in S.bring_up_to_date(df, path, buckets=4).collect())
    assert status(wanted.where("id < 's3'")) == sorted((f"s{i}", "written") for i in range(40) if f"s{i}" < "s3")
    assert status(wanted) == sorted((f"s{i}", "skipped" if f"s{i}" < "s3" else "written") for i in range(40))
    before = state(path)
    header = {r.split: tuple(r) for r in S.rebuilt_manifest(spark, path)[1].collect()}
    assert {k: v[1:4] for k, v in header.items()} == {"train": (20, 0, ["made"]), "dev": (20, 0, ["made"])}
    assert status(wanted) == sorted((f"s{i}", "skipped") for i in range(40)) and state(path) == before
    other = spark.createDataFrame([("dev", "s0", sample(0, "new"))], "split string, id string, body string")
    assert status(other) == [("s0", "skipped")] and state(path) == before
    # half of a file is lost: its last line is torn
    torn = sorted(f for f in before if "split=dev" in f and before[f][1].count("\n") > 2)[0]
    lines = before[torn][1].splitlines()
    open(torn, "w").write("\n".join([*lines[:-2], lines[-2][:9]]))
    os.remove(os.path.join(os.path.dirname(torn), f".{os.path.basename(torn)}.crc"))
    assert {r.split: (r.n, r.n_broken) for r in S.rebuilt_manifest(spark, path)[1].collect()} == {"train": (20, 0), "dev": (18, 1)}
    assert sum(s == "repaired" for _, s in status(wanted)) == 2
    assert {r.split: tuple(r) for r in S.rebuilt_manifest(spark, path)[1].collect()} == header
    untouched = {f: x for f, x in state(path).items() if f in before}
    assert all(before[f] == x for f, x in untouched.items()) and len(untouched) == len(before) - 1


def test_sink_takes_each_batch_once(spark, tmp_path):
    src, path, done = str(tmp_path / "src"), str(tmp_path / "steps"), str(tmp_path / "done")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("step"), F.concat(F.lit("p"), "id").alias("prompt_id"), F.lit("{}").alias("body")).coalesce(1)
    put = sink.step_sink(path, "r", 6)

    def drain(folder):
        stream = spark.readStream.schema("step long, prompt_id string, body string").parquet(src)
        stream.writeStream.foreachBatch(put).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()

    rows(0, 3).write.parquet(src)
    drain(done)
    assert tuple(sink.state_of(spark, path)) == (0, 2, 3, 6, False)
    rows(2, 6).write.mode("append").parquet(src)  # step 2 again
    drain(done)
    assert tuple(sink.state_of(spark, path)) == (1, 5, 6, 6, True)
    # the stream's own progress is lost: all batches come again
    drain(str(tmp_path / "other"))
    put(rows(0, 6), 0)
    put(rows(4, 6), 1)
    put(rows(0, 0), 7)
    assert sorted(r.step for r in sink.steps_of(spark, path).collect()) == list(range(6))
    assert tuple(sink.state_of(spark, path)) == (1, 5, 6, 6, True)
    # a commit that was cut off is written anew
    os.makedirs(f"{path}/.batch-8")
    put(rows(6, 7), 8)
    assert tuple(sink.state_of(spark, path)) == (8, 6, 7, 6, True)
