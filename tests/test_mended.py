"""Inputs that once gave wrong results."""

import pytest
from pyspark.sql import functions as F

from kiln.functions import code, hooks, mathnorm, rewards
from kiln.operators import curate, decontam, grading, groups, ranking, tokenize
from kiln.sources import io, tables
from kiln.streaming import jobs

from .conftest import SF_SMALL, one_col


@pytest.mark.parametrize("text,want", [("5d", 0.0), ("1.0f", 0.0), ("a\n 2.5 ", 2.5), ("1e3", 1000.0), ("x", 0.0)])
def test_sandbox_score(spark, text, want):
    assert one_col(spark, [text]).select(code.sandbox_score(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("text,want", [("3d", None), ("1,2", None), ("1,234.5", 1234.5), ("-2", -2.0), ("1/4", 0.25)])
def test_to_number(spark, text, want):
    assert one_col(spark, [text]).select(mathnorm.to_number(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("body,want", [("[1,1]", [1.0, 1.0]), ("[1,1] junk", None), ("[NaN,1]", None), ("[1", None)])
def test_reward_list(spark, body, want):
    got = one_col(spark, [f"<reward>{body}</reward>"]).select(rewards.parse_reward_list(F.col("c"))).first()[0]
    assert got == want or (want is None and None in (got or [None]))


def test_contest_id(spark):
    rows = one_col(spark, ["12/A", "gym/A"]).select(code.contest_id(F.col("c")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["0012", None]


def test_resume_with_fresh_checkpoint_keeps_earlier_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(40).withColumn("text", F.lit("t"))
    for n in (1, 2):
        rows.filter(F.col("id") < 20 * n).filter(F.col("id") >= 20 * (n - 1)).write.mode("append").parquet(folder)
        done = jobs.finished_keys(spark, out, "id")
        q = (
            jobs.file_stream(spark, folder, rows.schema)
            .writeStream.foreachBatch(jobs.append_new_rows(out, "id", done))
            .option("checkpointLocation", str(tmp_path / f"ck{n}"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).select("id").collect()) == list(range(40))


@pytest.mark.parametrize(
    "text,want",
    [
        (r"\boxed{1} so \boxed{\frac{\sqrt{\frac{1}{x^{2}}}}{3}}", r"\frac{\sqrt{\frac{1}{x^{2}}}}{3}"),
        (r"\boxed{4} and \boxed{5", "4"),
        (r"\boxed{\boxed{2}}", "2"),
        (r"{ \boxed{} }", ""),
        ("\\boxed{7} \\boxed{" + "x" * 200_000, "7"),
        ("\\boxed{" + "{" * 20_000 + "8" + "}" * 20_001, "{" * 20_000 + "8" + "}" * 20_000),
        ("no box", "no box"),
    ],
)
def test_last_boxed(spark, text, want):
    assert one_col(spark, [text]).select(mathnorm.answer_text("c")).first()[0] == want


def test_null_keys_keep_their_rows(spark):
    rows = [(None, 1.0), (None, 3.0), (1, 2.0), (1, 4.0)]
    df = spark.createDataFrame(rows, "prompt_id int, r double")
    got = groups.group_advantages(df, "r", scale_rewards=False).select("prompt_id", "advantage").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, -1.0), (0, 1.0), (1, -1.0), (1, 1.0)]
    lengths = df.select("prompt_id", F.col("r").cast("string").alias("c"), F.lit(True).alias("ok"))
    assert groups.length_reward(lengths, "c", "ok").count() == 4
    assert ranking.rank_within_groups(df, ["prompt_id"], ["r"]).count() == 4
    tests = spark.createDataFrame([(None, 1, 0.0, "WA"), (None, 2, 1.0, "AC")], "k int, batch_no int, score double, status string")
    assert grading.apply_early_stop(tests, ["k"]).count() == 2
    once = grading.early_stopped_scores(tests, ["k"]).first()
    assert (once["subtask_score"], once["subtask_status"], once["n_tests"], once["n_skipped"]) == (0.0, "WA", 2, 1)
    steps = df.select("prompt_id", F.col("r").cast("int").alias("step"), F.lit(2).alias("amount"))
    sums = groups.cumulative_by_step(steps, "amount", "step", ["prompt_id"]).collect()
    assert sorted((r["prompt_id"] or 0, r["cumulative"]) for r in sums) == [(0, 2), (0, 4), (1, 2), (1, 4)]


def test_null_texts_are_one_text(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "A ")], "id int, text string")
    assert sorted(r["id"] for r in decontam.exact_dedup(df, "id", "text").collect()) == [1, 3]


def test_malformed_lines_do_not_depend_on_columns(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n{"a": "no", "b": "y"}\n\n{"a": 2, "b"\n')
    df = io.read_jsonl(spark, str(path), "a INT, b STRING", skip_malformed=True)
    assert [tuple(r) for r in df.collect()] == [(1, "x")]
    assert [r[0] for r in df.select("b").collect()] == ["x"] and df.count() == 1


def test_words_outside_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "a zzz b")], "id int, text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "word string, token_id int")
    out, _ = tokenize.whitespace_vocabulary_ids(df, "id", "text", vocab, unknown_id=9)
    assert out.first()["input_ids"] == [0, 9, 1]
    with pytest.raises(Exception, match="outside the vocabulary"):
        tokenize.whitespace_vocabulary_ids(df, "id", "text", vocab)[0].collect()


def test_rows_without_gold_stay(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "id int, question string")
    gold = spark.createDataFrame([("p", "5", 0)], "question string, answer string, o int")
    got = curate.join_gold(rows, gold, "question", "o", strict=False).select("id", "answer").collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, "5"), (2, None)]


def test_no_tests(spark):
    results = spark.createDataFrame([(1, 1, 1.0, "", 0, "AC")], "submission_id int, batch_no int, score double, feedback string, subtask int, status string")
    both = spark.createDataFrame([(1, 0), (2, 0)], "submission_id int, subtask int")
    s = {r["submission_id"]: r for r in grading.cf_submission_scores(results, submissions=both.select("submission_id")).collect()}
    assert s[1]["partial"] == 1.0 and s[2]["partial"] is None and s[2]["n_tests"] == 0
    t = {r["submission_id"]: r for r in grading.subtask_scores(results, subtasks=both).collect()}
    assert t[1]["subtask_score"] == 1.0 and t[2]["subtask_score"] == 0.0 and t[2]["subtask_status"] is None


def test_generated_tests_follow_official_ones(spark):
    schema = "problem_id int, test_name string, input string, output string"
    official = spark.createDataFrame([(1, "b", "2", "2"), (1, "a", "1", "1")], schema)
    extra = spark.createDataFrame([(1, "a", "3", "3"), (2, "a", "4", "4")], schema)
    problems = spark.createDataFrame([(1,), (2,), (3,)], "problem_id int")
    got = {r["problem_id"]: [t["input"] for t in r["test_cases"]] for r in grading.tests_by_problem(problems, official, generated=extra).collect()}
    assert got == {1: ["1", "2", "3"], 2: ["4"], 3: []}


@pytest.mark.parametrize(
    "text,gone,there",
    [
        ("from fractions import gcd, Fraction\nprint(1)", "fractions import gcd", "from fractions import Fraction"),
        ("from fractions import Fraction, gcd\nprint(1)", "Fraction, gcd", "from fractions import Fraction"),
        ("from fractions import (\n  gcd,\n  Fraction)\nprint(1)", "  gcd,", "Fraction)"),
        ("from collections import Mapping\nos . getlogin ( )", "getlogin", "collections.abc import Mapping"),
        ("x=1\\\n\n\ny", "\\\n\n", "x=1\\\ny"),
        ("import os\nx=1\\\\", "x=1\\", "set_int_max_str_digits(0)"),
    ],
)
def test_python_patches(spark, text, gone, there):
    out = one_col(spark, [text]).select(code.patch_code("c", "python")).first()[0]
    assert gone not in out and there in out


def test_length_reward_by_name(spark):
    df = spark.createDataFrame([("<answer>1</answer>", 1), ("<answer>1</answer>  ", 1), ("<answer>2</answer>    ", 1)], "c string, p int")
    reward = hooks.get_rewards(["length"])[0]
    got = [r[0] for r in df.select(reward("c", F.lit("<answer>1</answer>"), scope="p").alias("v"), F.length("c").alias("n")).orderBy("n").collect()]
    assert got == [0.5, 0.0, -0.5]


def test_spread_is_off_by_default(spark):
    assert "RoundRobin" not in tables.read_table(spark, SF_SMALL, "documents")._jdf.queryExecution().toString()
