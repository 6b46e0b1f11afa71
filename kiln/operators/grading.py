"""Scoring of graded test-result tables.

Running code in sandboxes is outside this library; these operators take the
long table of per-test results a sandbox run produces and aggregate it the
way the competitive-programming scorers do. All per-submission aggregates are
``groupBy`` with conditional aggregates (partial aggregation, skew-safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import STATUS_PRIORITY, status_priority, test_status
from ..functions.text import py_strip
from .sizing import join_on_nullable

NO_COMPILE_REWARD = -0.1
NO_SUBMISSION_REWARD = -1.0


def cf_submission_scores(
    results: DataFrame,
    submission: str = "submission_id",
    batch: str = "batch_no",
    passed: Column | None = None,
    compile_error: Column | None = None,
    has_code: Column | None = None,
    modes: Sequence[str] = ("pass_fail", "partial", "weighted_sum"),
    submissions: DataFrame | None = None,
) -> DataFrame:
    """One score column per scoring mode.

    * compile error seen in a run batch → −0.1 (in ``pass_fail`` the run stops
      after the first batch with a failing test, so a compile error in a later
      batch is never seen);
    * no extracted code → −1.0;
    * no tests → NULL, for those of ``submissions`` (one row each) without results;
    * ``pass_fail`` = 1 if every test passed; ``partial`` = passed/total;
      ``weighted_sum`` = pass_fail + 0.1·partial.
    """
    ok = passed if passed is not None else (F.col("score") == 1.0)
    ce = compile_error if compile_error is not None else F.instr(F.col("feedback"), "Compilation error") > 0
    code = has_code if has_code is not None else F.lit(True)
    agg = results.groupBy(submission).agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.count(F.when(ok, 1)).alias("n_passed"),
        F.min(F.when(~ok, F.col(batch))).alias("_first_fail"),
        F.min(F.when(ce, F.col(batch))).alias("_first_ce"),
        F.bool_and(code).alias("_has_code"),
    )
    if submissions is not None:
        agg = submissions.join(agg, submission, "left").fillna(0, ["n_tests", "n_passed"])
    ratio = F.try_divide(F.col("n_passed"), F.col("n_tests"))
    all_pass = F.when(F.col("n_passed") == F.col("n_tests"), F.lit(1.0)).otherwise(F.lit(0.0))
    ce_any = F.col("_first_ce").isNotNull()
    ce_seen_pf = ce_any & (F.col("_first_fail").isNull() | (F.col("_first_ce") <= F.col("_first_fail")))
    out = agg
    for mode in modes:
        if mode == "pass_fail":
            val, seen = all_pass, ce_seen_pf
        elif mode == "partial":
            val, seen = ratio, ce_any
        elif mode == "weighted_sum":
            val, seen = all_pass + F.lit(0.1) * ratio, ce_any
        else:
            raise ValueError(f"unknown scoring mode {mode!r}")
        score = (
            F.when(F.col("n_tests") == 0, F.lit(None).cast("double"))
            .when(~F.col("_has_code"), F.lit(NO_SUBMISSION_REWARD))
            .when(seen, F.lit(NO_COMPILE_REWARD))
            .otherwise(val)
        )
        out = out.withColumn(mode, score)
    return out.drop("_first_fail", "_first_ce", "_has_code")


def with_test_status(results: DataFrame, score: str = "score", feedback: str = "feedback") -> DataFrame:
    """Per-test status code from score and judge feedback."""
    return results.withColumn("status", test_status(F.col(score), F.col(feedback)))


def apply_early_stop(results: DataFrame, keys: Sequence[str], batch: str = "batch_no") -> DataFrame:
    """Tests in batches after the first batch with a zero score are never run.

    They keep the initial result: status ``SKIPPED``, score 0.
    """
    first = results.groupBy(*keys).agg(F.min(F.when(F.col("score") == 0.0, F.col(batch))).alias("_stop"))
    j = join_on_nullable(results, first, list(keys))
    skipped = F.col("_stop").isNotNull() & (F.col(batch) > F.col("_stop"))
    return (
        j.withColumn("status", F.when(skipped, F.lit("SKIPPED")).otherwise(F.col("status")))
        .withColumn("score", F.when(skipped, F.lit(0.0)).otherwise(F.col("score")))
        .drop("_stop")
    )


def subtask_scores(
    results: DataFrame,
    keys: Sequence[str] = ("submission_id", "subtask"),
    points: Column | None = None,
    precision: int = 2,
    extra: Sequence[Column] = (),
    subtasks: DataFrame | None = None,
) -> DataFrame:
    """Subtask score = round(min test score), weighted by points; worst status.

    ``results`` needs ``score`` and ``status``; ``points`` is a column of the
    subtask's maximum points (default 1). Those of ``subtasks`` (one row for each
    key) without tests score 0 and have no status.
    """
    pts = points if points is not None else F.lit(1.0)
    g = results.withColumn("_prio", status_priority(F.col("status"))).withColumn("_pts", pts)
    # Numeric buffers only, so the aggregate hashes; the worst status is named afterwards.
    scored = g.groupBy(*keys).agg(
        F.bround(F.min("score"), precision).alias("subtask_score"),
        F.bround(F.min("score") * F.max("_pts"), precision).alias("weighted_score"),
        F.min("_prio").alias("_prio"),
        F.count(F.lit(1)).alias("n_tests"),
        *extra,
    )
    scored = scored.withColumn("subtask_status", _status_of(F.col("_prio"))).drop("_prio")
    if subtasks is None:
        return scored
    zero = {"subtask_score": 0.0, "weighted_score": 0.0, "n_tests": 0}
    return subtasks.select(*keys).join(scored, list(keys), "left").fillna(zero)


def early_stopped_scores(
    results: DataFrame,
    keys: Sequence[str] = ("submission_id", "subtask"),
    batch: str = "batch_no",
    points: Column | None = None,
    precision: int = 2,
) -> DataFrame:
    """:func:`subtask_scores` of :func:`apply_early_stop` from one scan, plus ``n_skipped``.

    Tests shrink to numbers for each batch first. The first batch with a zero score
    decides: its worst status counts (earlier batches have none as bad), all later
    tests are skipped. Scores are 0 or above.
    """
    pts = points if points is not None else F.lit(1.0)
    keys = list(keys)
    per_batch = (
        results.select(*keys, batch, "score", status_priority(F.col("status")).alias("_prio"), pts.alias("_pts"))
        .groupBy(*keys, F.col(batch).alias("_b"))
        .agg(
            F.min("score").alias("_min"),
            F.min("_prio").alias("_prio"),
            F.max("_pts").alias("_pts"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    failed = F.col("_min") == 0.0
    out = per_batch.groupBy(*keys).agg(
        F.min("_min").alias("_low"),
        F.max("_pts").alias("_pts"),
        F.min(F.when(failed, F.struct("_b", "_prio"))).alias("_stop"),
        F.min("_prio").alias("_prio"),
        F.sum("_n").alias("n_tests"),
        F.collect_list(F.struct("_b", "_n")).alias("_sizes"),  # one small entry for each batch of the key
    )
    after = F.aggregate(
        F.filter("_sizes", lambda s: s["_b"] > F.col("_stop._b")), F.lit(0).cast("long"), lambda total, s: total + s["_n"]
    )
    return out.select(
        *keys,
        F.bround("_low", precision).alias("subtask_score"),
        F.bround(F.col("_low") * F.col("_pts"), precision).alias("weighted_score"),
        _status_of(F.coalesce("_stop._prio", "_prio")).alias("subtask_status"),
        "n_tests",
        F.coalesce(after, F.lit(0).cast("long")).alias("n_skipped"),
    )


def _status_of(priority: Column) -> Column:
    """The status with a priority number."""
    return F.element_at(F.create_map(*[F.lit(x) for s, p in STATUS_PRIORITY.items() for x in (p, s)]), priority)


def stdout_test_passed(stdout: Column, expected: Column, exit_code: Column) -> Column:
    """Line-wise stripped comparison over the shorter of the two line lists."""
    got = F.split(py_strip(stdout), "\n")
    want = F.split(expected, "\n")
    n = F.least(F.size(got), F.size(want))
    pairs = F.arrays_zip(F.slice(got, 1, n).alias("g"), F.slice(want, 1, n).alias("w"))
    same = F.forall(pairs, lambda p: py_strip(p["g"]) == py_strip(p["w"]))
    return (exit_code == 0) & same


def success_rates(tests: DataFrame, submission: str, passed: str = "passed", extra: Sequence[Column] = ()) -> DataFrame:
    """Passed / total per submission (no tests → NULL rather than a division error)."""
    return tests.groupBy(submission).agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.try_divide(F.count(F.when(F.col(passed), 1)).cast("double"), F.count(F.lit(1)).cast("double")).alias(
            "success_rate"
        ),
        *extra,
    )


def tests_by_problem(
    problems: DataFrame,
    tests: DataFrame,
    problem: str = "problem_id",
    order: str = "test_name",
    generated: DataFrame | None = None,
) -> DataFrame:
    """Each problem with its test list (missing → empty list).

    ``generated`` tests (the same columns) follow the official ones. Tests are
    grouped per problem first, then joined to the problem table, so the join
    carries one row per problem; a problem's list is part of the output row.
    """
    tests = tests.select(problem, order, "input", "output").withColumn("_o", F.struct(F.lit(0).alias("part"), F.col(order).alias("name")))
    if generated is not None:
        extra = generated.select(problem, order, "input", "output")
        tests = tests.unionByName(extra.withColumn("_o", F.struct(F.lit(1).alias("part"), F.col(order).alias("name"))))
    packed = tests.groupBy(problem).agg(
        F.array_sort(F.collect_list(F.struct("_o", "input", "output"))).alias("_t")
    )
    j = problems.join(packed, problem, "left")
    tc = F.coalesce(
        F.transform("_t", lambda s: F.struct(s["input"].alias("input"), s["output"].alias("output"))),
        F.array().cast("array<struct<input:string,output:string>>"),
    )
    return j.withColumn("test_cases", tc).drop("_t")


__all__ = [
    "STATUS_PRIORITY",
    "cf_submission_scores",
    "with_test_status",
    "apply_early_stop",
    "subtask_scores",
    "stdout_test_passed",
    "success_rates",
    "tests_by_problem",
]
