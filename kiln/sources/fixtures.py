"""Stand-in inputs in the schemas the jobs expect, derived from the test tables.

These only reshape rows (the derived views of FIXTURES.md); every job that
consumes them is schema-driven and takes nothing from how they are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

def _nl():
    return F.lit("\n")


def _s(c):
    return c.cast("string")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four generations per prompt in five response shapes.

    Columns: doc_id, prompt_id, gen_idx, gold, solution, completion.
    """
    return rollouts_from(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def rollouts_from(docs: DataFrame) -> DataFrame:
    """The rollout reshaping on any frame with ``doc_id, text`` (batch or stream)."""
    d = docs.select("doc_id", "text")
    pid = F.floor(F.col("doc_id") / 4).cast("bigint")
    gold = _s(pid % 7)
    pred = F.when(F.col("doc_id") % 3 == 0, _s(pid % 7)).otherwise(_s(F.col("doc_id") % 7))
    t = d.select(
        "doc_id",
        pid.alias("prompt_id"),
        (F.col("doc_id") % 4).alias("gen_idx"),
        "text",
        gold.alias("gold"),
        pred.alias("pred"),
    )
    NL = _nl()
    think = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"))
    ans = F.concat(F.lit("<answer>"), F.col("pred"), F.lit("</answer>"))
    k = F.col("doc_id") % 5
    completion = (
        F.when(k == 0, F.concat(think, NL, ans))
        .when(
            k == 1,
            F.concat(
                think, NL, ans, NL, F.lit("<evaluation>ok</evaluation>"), NL,
                F.lit("<reward>["), _s(F.col("doc_id") % 2), F.lit(",1]</reward>"),
            ),
        )
        .when(k == 2, F.concat(think, NL, F.lit("<answer>"), F.col("pred")))
        .when(k == 3, F.col("text"))
        .otherwise(F.concat(think, F.lit("<answer> "), F.col("pred"), F.lit(" </answer><answer>x</answer>")))
    )
    return t.select(
        "doc_id",
        "prompt_id",
        "gen_idx",
        "gold",
        F.concat(F.lit("<answer>"), F.col("gold"), F.lit("</answer>")).alias("solution"),
        completion.alias("completion"),
    )


def qa_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reasoning #### result`` records: index, question, answer."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(
        F.col("doc_id").alias("index"),
        F.concat(F.lit("Q"), _s(F.col("doc_id")), F.lit(" "), F.col("text")).alias("question"),
        F.concat(F.col("text"), F.lit(" #### "), _s(F.col("doc_id") % 11)).alias("answer"),
    )


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded test runs: submission_id, subtask, batch_no, test_name, score, feedback."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    q = F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").alias("submission_id"),
        (F.col("l_linenumber") % 2).cast("int").alias("subtask"),
        F.col("l_linenumber").alias("batch_no"),
        F.concat_ws("_", _s(F.col("l_linenumber")), _s(F.col("l_partkey")), _s(F.col("l_suppkey"))).alias("test_name"),
        F.when(q < 5, F.lit(0.0)).when(q < 10, F.lit(0.5)).otherwise(F.lit(1.0)).cast("double").alias("score"),
        F.when(q < 2, F.lit("Compilation error"))
        .when(q < 3, F.lit("Time limit exceeded"))
        .when(q < 5, F.lit("Output isn't correct"))
        .otherwise(F.lit(""))
        .alias("feedback"),
    )


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged training metrics: step, metric, mode, value."""
    e = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    return e.select(
        F.floor(F.col("event_id") / 50).cast("bigint").alias("step"),
        F.col("event_type").alias("metric"),
        F.when(F.col("event_id") % 10 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("mode"),
        "value",
    )


def branch_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts in the shapes that :func:`rollouts` does not have; a prompt's four generations share one shape.

    By ``prompt_id % 6``: 0 four equal wrong answers; 1 newline-strict and right; 2
    numbered steps, none to four of them; 3 a boxed fraction, right for even
    generations; 4 a gold that cannot be read; 5 tags missing.
    """
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    pid = F.floor(F.col("doc_id") / 4).cast("bigint")
    gen, gold, text, NL = F.col("doc_id") % 4, pid % 7, F.col("text"), _nl()
    steps = F.concat(
        F.when(gen > 0, F.concat(F.lit("1. Start\n- "), text)).otherwise(text),
        F.when(gen > 1, F.lit("\nFirst, look")).otherwise(""),
        F.when(gen > 2, F.lit("\nStep 2: go on. Finally, stop")).otherwise(""),
    )
    strict = F.concat(F.lit("<think>\n"), text, F.lit("\n</think>\n<answer>\n"), _s(gold), F.lit("\n</answer>"))
    boxed = F.concat(text, F.lit(" so \\boxed{\\frac{"), _s((gold + gen % 2) * 2), F.lit("}{2}}"))
    tagless = F.concat(F.lit("<think>\n"), text, F.lit("\n</think>\n"), F.when(gen > 1, F.lit("<answer>\n")).otherwise(""))
    k = pid % 6
    return d.select(
        "doc_id",
        pid.alias("prompt_id"),
        gen.alias("gen_idx"),
        F.when(k == 4, F.lit("<answer> </answer>")).otherwise(F.concat(F.lit("<answer>"), _s(gold), F.lit("</answer>"))).alias("solution"),
        F.when(k == 0, F.lit("<answer>9</answer>"))
        .when(k == 1, strict)
        .when(k == 2, steps)
        .when(k == 3, boxed)
        .when(k == 4, F.concat(F.lit("<answer>"), _s(gold), F.lit("</answer>"), NL, text))
        .otherwise(tagless)
        .alias("completion"),
    )
