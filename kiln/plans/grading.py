"""Submission grading jobs over test-result tables (code-reward family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions.rewards import binary_reward
from ..operators import grading as GR
from ..sources.fixtures import test_results
from ..sources.tables import read_table
from . import sqltext as S
from .curation import _lit
from .registry import query

_CF_SQL = f"""
WITH {S.TEST_RESULTS.strip()},
a AS (SELECT submission_id, count(*) AS n_tests, count(*) FILTER (WHERE score = 1.0) AS n_passed,
             min(batch_no) FILTER (WHERE score <> 1.0) AS ff,
             min(batch_no) FILTER (WHERE instr(feedback, 'Compilation error') > 0) AS fce
      FROM test_results GROUP BY submission_id)
SELECT o_orderkey AS submission_id, coalesce(n_tests, 0) AS n_tests, coalesce(n_passed, 0) AS n_passed,
       CASE WHEN n_tests IS NULL THEN NULL WHEN fce IS NOT NULL AND (ff IS NULL OR fce <= ff) THEN -0.1
            WHEN n_passed = n_tests THEN 1.0 ELSE 0.0 END::DOUBLE AS pass_fail,
       CASE WHEN n_tests IS NULL THEN NULL WHEN fce IS NOT NULL THEN -0.1 ELSE n_passed / n_tests END::DOUBLE AS partial,
       CASE WHEN n_tests IS NULL THEN NULL WHEN fce IS NOT NULL THEN -0.1
            ELSE (CASE WHEN n_passed = n_tests THEN 1.0 ELSE 0.0 END) + 0.1 * (n_passed / n_tests) END::DOUBLE AS weighted_sum,
       CASE WHEN n_tests IS NULL THEN NULL WHEN fce IS NOT NULL THEN 0.0 WHEN n_passed / n_tests > 0.99 THEN 1.0 ELSE 0.0 END::DOUBLE AS binary_partial
FROM orders LEFT JOIN a ON o_orderkey = submission_id
"""


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All submissions; some have no test results."""
    return read_table(spark, sf_dir, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("submission_id"))


@query("cf_submission_scores", ids=("A11", "R23"), sql=_CF_SQL)
def q_cf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-submission scores in the three scoring modes, plus the binary threshold of ``partial``."""
    s = GR.cf_submission_scores(test_results(spark, sf_dir), submissions=_submissions(spark, sf_dir))
    return s.withColumn("binary_partial", binary_reward(F.col("partial")))


_POINTS = "CASE WHEN subtask = 0 THEN 40.0 ELSE 60.0 END"


def _status_sql(score: str, fb: str) -> str:
    return (
        f"CASE WHEN {score} = 0.0 THEN (CASE WHEN instr({fb}, 'Compilation error') > 0 THEN 'CE' "
        f"WHEN instr({fb}, 'Memory limit exceeded') > 0 THEN 'MLE' WHEN instr({fb}, 'Time limit exceeded') > 0 THEN 'TLE' "
        f"WHEN instr({fb}, 'Output isn''t correct') > 0 THEN 'WA' ELSE 'RE' END) "
        f"WHEN {score} = 1.0 THEN 'AC' ELSE 'PA' END"
    )


_PRIO = (
    "CASE status WHEN 'CE' THEN -1 WHEN 'RE' THEN 0 WHEN 'WA' THEN 1 WHEN 'MLE' THEN 2 "
    "WHEN 'TLE' THEN 3 WHEN 'PA' THEN 4 WHEN 'AC' THEN 5 WHEN 'SKIPPED' THEN 999 END"
)

_IOI_SQL = f"""
WITH {S.TEST_RESULTS.strip()},
s AS (SELECT *, {_status_sql('score', 'feedback')} AS status FROM test_results)
SELECT w.submission_id, w.subtask, coalesce(round_even(min(score), 2), 0.0) AS subtask_score,
       coalesce(round_even(min(score) * min(CASE WHEN w.subtask = 0 THEN 40.0 ELSE 60.0 END), 2), 0.0) AS weighted_score,
       arg_min(status, {_PRIO}) AS subtask_status, count(s.submission_id) AS n_tests
FROM (SELECT o_orderkey AS submission_id, unnest([0, 1]) AS subtask FROM orders) w
LEFT JOIN s ON w.submission_id = s.submission_id AND w.subtask = s.subtask GROUP BY w.submission_id, w.subtask
"""


def _points():
    return F.when(F.col("subtask") == 0, F.lit(40.0)).otherwise(F.lit(60.0))


@query("ioi_subtask_scores", ids=("A12", "A13", "R31"), sql=_IOI_SQL)
def q_ioi_subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtask score = min test score, weighted by points (40/60), worst status by priority."""
    r = GR.with_test_status(test_results(spark, sf_dir))
    wanted = _submissions(spark, sf_dir).select("submission_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("subtask"))
    return GR.subtask_scores(r, ("submission_id", "subtask"), points=_points(), subtasks=wanted)


_EARLY_SQL = f"""
WITH {S.TEST_RESULTS.strip()},
s AS (SELECT *, {_status_sql('score', 'feedback')} AS status,
             min(CASE WHEN score = 0.0 THEN batch_no END) OVER (PARTITION BY submission_id, subtask) AS stop
      FROM test_results),
e AS (SELECT submission_id, subtask, test_name,
             CASE WHEN stop IS NOT NULL AND batch_no > stop THEN 'SKIPPED' ELSE status END AS status,
             CASE WHEN stop IS NOT NULL AND batch_no > stop THEN 0.0 ELSE score END AS score FROM s)
SELECT submission_id, subtask, round_even(min(score), 2) AS subtask_score,
       round_even(min(score) * min({_POINTS}), 2) AS weighted_score,
       arg_min(status, {_PRIO}) AS subtask_status, count(*) AS n_tests,
       count(*) FILTER (WHERE status = 'SKIPPED') AS n_skipped
FROM e GROUP BY submission_id, subtask
"""


@query("ioi_early_stop", ids=("A14",), sql=_EARLY_SQL)
def q_ioi_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests after the first failing batch stay SKIPPED with score 0; then subtask scores."""
    r = GR.with_test_status(test_results(spark, sf_dir))
    return GR.early_stopped_scores(r, ("submission_id", "subtask"), points=_points())


def _stdout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in sandbox runs: expected output, captured stdout and exit code per test."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"])
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    k = F.col("l_linenumber") % 3
    stdout = (
        F.when(k == 0, F.concat(p, F.lit("\n"), (F.col("l_suppkey") + 1).cast("string")))
        .when(k == 1, F.concat(F.lit(" "), p, F.lit(" \n"), s, F.lit("\n\n")))
        .otherwise(p)
    )
    return li.select(
        F.col("l_orderkey").alias("submission_id"),
        F.col("l_linenumber").alias("test_no"),
        F.concat(p, F.lit("\n"), s).alias("expected"),
        stdout.alias("stdout"),
        F.when(F.col("l_discount") > 0.09, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
    )


_STDOUT_SQL = f"""
WITH r AS (
  SELECT l_orderkey AS submission_id, concat(cast(l_partkey AS varchar), chr(10), cast(l_suppkey AS varchar)) AS expected,
         CASE WHEN l_linenumber % 3 = 0 THEN concat(cast(l_partkey AS varchar), chr(10), cast(l_suppkey + 1 AS varchar))
              WHEN l_linenumber % 3 = 1 THEN concat(' ', cast(l_partkey AS varchar), ' ', chr(10), cast(l_suppkey AS varchar), chr(10), chr(10))
              ELSE cast(l_partkey AS varchar) END AS stdout,
         CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS exit_code FROM lineitem),
z AS (SELECT submission_id, exit_code, stdout,
             string_split({S.strip('stdout')}, chr(10)) AS g, string_split(expected, chr(10)) AS w FROM r),
t AS (SELECT submission_id, stdout, exit_code = 0 AND
             len(list_filter(range(1, least(len(g), len(w)) + 1), lambda i: {S.strip('g[i]')} <> {S.strip('w[i]')})) = 0 AS passed
      FROM z)
SELECT submission_id, count(*) AS n_tests, (count(*) FILTER (WHERE passed)) / count(*) AS success_rate,
       sum(coalesce(try_cast({S.strip(f"string_split({S.strip('stdout')}, chr(10))[-1]")} AS DOUBLE),
                    try_cast({S.strip('stdout')} AS DOUBLE), 0.0)) AS sandbox_score_sum
FROM t GROUP BY submission_id
"""


@query("stdout_grading", ids=("R30", "R32"), sql=_STDOUT_SQL)
def q_stdout_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-wise stdout grading → success rate per submission; last-line score parsing."""
    runs = _stdout_runs(spark, sf_dir)
    t = runs.withColumn("passed", GR.stdout_test_passed(F.col("stdout"), F.col("expected"), F.col("exit_code")))
    t = t.withColumn("sandbox_score", C.sandbox_score("stdout"))
    return GR.success_rates(t, "submission_id", extra=[F.sum("sandbox_score").alias("sandbox_score_sum")])


_TESTS_SQL = """
WITH t AS (SELECT l_orderkey AS problem_id, concat(cast(l_linenumber AS varchar), '_', cast(l_partkey AS varchar)) AS test_name,
                  cast(l_partkey AS varchar) AS input, cast(l_suppkey AS varchar) AS output FROM lineitem),
g AS (SELECT problem_id, list(concat(input, '->', output) ORDER BY test_name, input, output) AS tests FROM t GROUP BY problem_id)
SELECT o.o_orderkey AS problem_id, printf('%04d', CAST(o.o_custkey AS INTEGER)) AS contest_id,
       coalesce(len(g.tests), 0) AS n_tests, coalesce(g.tests, []) AS tests
FROM orders o LEFT JOIN g ON o.o_orderkey = g.problem_id
"""


@query("test_cases_by_problem", ids=("A17", "J6", "C18"), sql=_TESTS_SQL)
def q_tests_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every problem (order) with its list of test cases (line items); none → empty list."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    tests = li.select(
        F.col("l_orderkey").alias("problem_id"),
        F.concat_ws("_", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("test_name"),
        F.col("l_partkey").cast("string").alias("input"),
        F.col("l_suppkey").cast("string").alias("output"),
    )
    problems = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).select(
        F.col("o_orderkey").alias("problem_id"),
        C.contest_id(F.concat(F.col("o_custkey").cast("string"), F.lit("/A"))).alias("contest_id"),
    )
    j = GR.tests_by_problem(problems, tests)
    return j.select(
        "problem_id",
        "contest_id",
        F.size("test_cases").alias("n_tests"),
        F.transform("test_cases", lambda s: F.concat(s["input"], F.lit("->"), s["output"])).alias("tests"),
    )


_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


# Submissions made of fixed parts around a document's text: (import part, call in the body, import part afterwards).
_SUBMISSIONS = (
    ("from fractions import gcd", "fractions.gcd(4, 6)", ""),
    ("from fractions import gcd, Fraction", "fractions.gcd(4, 6)", "from fractions import Fraction"),
    ("from fractions import Fraction, gcd", "fractions.gcd(4, 6)", "from fractions import Fraction"),
    ("from fractions import (\n  gcd,\n  Fraction)", "fractions.gcd(4, 6)", "from fractions import (\n  Fraction)"),
    ("from collections import Mapping, deque", "gcd(4, 6)", "from collections.abc import Mapping, deque"),
)
_MIDDLE = "\nimport imp\nx = \'\'\'"
_MIDDLE_AFTER = "\nimport importlib\nx = \'\'\'"
_LAST_IMPORT = "\'\'\'\nimport inspect"


def _body(call: str) -> str:
    return f"\nprint({call}, os . getlogin ( ), getlogin(), inspect.getargspec)\ny = 1 + \\\n\n\n2\n"


def _body_after(call: str) -> str:
    return f"\nimport inspect\nprint({call.replace('fractions', 'math')}, False, False, inspect.getfullargspec)\ny = 1 + \\\n2"


def _case(values: list[str]) -> str:
    return "CASE doc_id // 2 % 5 " + " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(values)) + " END"


_IMPORTED = ["\nimport math" if "fractions" in call else "\nfrom math import gcd" for _, call, _ in _SUBMISSIONS]
_TEXT_LINES = f"regexp_replace(text, '{_BREAKS}', chr(10), 'g')"

# The patched text is put together from the parts as they must come out.
_PATCH_SQL = rf"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'cpp' END AS language, 1.0::DOUBLE AS code_format,
  CASE WHEN doc_id % 2 = 0
    THEN concat({_case([c for _, _, c in _SUBMISSIONS])}, {_lit(_MIDDLE_AFTER)}, {_TEXT_LINES}, {_lit(_LAST_IMPORT)},
                {_case(_IMPORTED)}, {_lit(C.NO_DIGIT_LIMIT)}, {_case([_body_after(call) for _, call, _ in _SUBMISSIONS])})
    ELSE concat({_lit(C.CPP_HEADER)}, 'int main() {{ std::string s = "', text, '"; }}', chr(10)) END AS patched
FROM documents
"""


@query("code_patching", ids=("R33", "R15", "R16"), sql=_PATCH_SQL)
def q_code_patching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the code block of a tagged answer, check code format, patch by language."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lang = F.when(F.col("doc_id") % 2 == 0, F.lit("python")).otherwise(F.lit("cpp"))
    text = F.col("text")
    which = F.floor(F.col("doc_id") / 2) % len(_SUBMISSIONS)
    python = F.lit("")
    for i, (imports, call, _) in enumerate(_SUBMISSIONS):
        parts = F.concat(F.lit(imports + _MIDDLE), text, F.lit(_LAST_IMPORT + _body(call)))
        python = F.when(which == i, parts).otherwise(python)
    body = F.when(lang == "python", python).otherwise(F.concat(F.lit("int main() { std::string s = \""), text, F.lit("\"; }\n")))
    completion = F.concat(F.lit("<think>plan</think><answer>```"), lang, F.lit("\n"), body, F.lit("```</answer>"))
    t = d.select("doc_id", lang.alias("language"), completion.alias("completion"))
    t = t.withColumn("code", C.extract_code(F.col("completion"), F.col("language")))
    return t.select(
        "doc_id",
        "language",
        C.code_format_reward(F.col("completion"), F.col("language")).alias("code_format"),
        C.patch_code("code", F.col("language")).alias("patched"),
    )
