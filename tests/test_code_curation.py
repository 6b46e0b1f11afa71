"""Code columns, grading and curation helpers on literal cases."""

import pytest
from pyspark.sql import functions as F

from kiln.functions import code as C
from kiln.functions import curation as CU
from kiln.operators import grading as GR
from kiln.sources import io as IO
from kiln.streaming.jobs import scratch_dir


def test_extract_code_and_format(spark):
    txt = "<think>x</think><answer>```python\nprint(1)\n``` and ```python\nprint(2)\n```</answer>"
    df = spark.createDataFrame([(txt, "python"), (txt, "cpp"), (txt, None)], "c string, lang string")
    out = df.select(C.extract_code("c", F.col("lang")).alias("code"), C.code_format_reward("c", F.col("lang")).alias("f")).collect()
    assert out[0].code == "print(2)\n" and out[0].f == 1.0
    assert out[1].code == "" and out[1].f == 0.0
    assert out[2].code == ""


def test_patch_code(spark):
    src = "from fractions import gcd\nimport imp\nx = fractions.gcd(4, 6)\n"
    df = spark.createDataFrame([(src, "python"), ("int main(){}", "cpp"), ("std::cout;", "C++17"), ("", "python")], "c string, l string")
    out = [r[0] for r in df.select(C.patch_code("c", F.col("l"))).collect()]
    assert "from math import gcd" not in out[0] and "import math" in out[0]
    assert "import importlib" in out[0] and "math.gcd(4, 6)" in out[0]
    assert "sys.set_int_max_str_digits(0)" in out[0]
    assert out[1].startswith("#include <bits/stdc++.h>\n\nusing namespace std;")
    assert out[2] == "#include <bits/stdc++.h>\nstd::cout;"
    assert out[3] == ""


def test_status_and_scores(spark):
    rows = [
        (1, 0, 1, "t1", 1.0, ""),
        (1, 0, 2, "t2", 0.0, "Output isn't correct"),
        (1, 0, 3, "t3", 0.0, "Compilation error"),
        (2, 0, 1, "t1", 1.0, ""),
        (2, 0, 2, "t2", 0.5, ""),
        (3, 0, 1, "t1", 0.0, "Compilation error"),
    ]
    df = spark.createDataFrame(rows, "submission_id long, subtask int, batch_no int, test_name string, score double, feedback string")
    cf = {r.submission_id: r for r in GR.cf_submission_scores(df).collect()}
    assert cf[1].pass_fail == 0.0  # the run stops at batch 2, compile error in batch 3 unseen
    assert cf[1].partial == -0.1 and cf[3].pass_fail == -0.1
    assert cf[2].partial == 0.5 and cf[2].weighted_sum == pytest.approx(0.05)
    st = GR.with_test_status(df)
    assert [r.status for r in st.orderBy("submission_id", "batch_no").collect()] == ["AC", "WA", "CE", "AC", "PA", "CE"]
    es = GR.apply_early_stop(st, ["submission_id", "subtask"])
    s1 = {r.test_name: r.status for r in es.filter("submission_id = 1").collect()}
    assert s1 == {"t1": "AC", "t2": "WA", "t3": "SKIPPED"}
    sub = {r.submission_id: r for r in GR.subtask_scores(es, points=F.lit(50.0)).collect()}
    assert sub[1].subtask_status == "WA" and sub[2].weighted_score == 25.0 and sub[3].subtask_status == "CE"


def test_stdout_and_sandbox(spark):
    df = spark.createDataFrame([(" 1 \n2\n", "1\n2", 0), ("1\n3", "1\n2", 0), ("1", "1\n2", 0), ("1\n2", "1\n2", 1)], "o string, e string, x int")
    assert [r[0] for r in df.select(GR.stdout_test_passed(F.col("o"), F.col("e"), F.col("x"))).collect()] == [True, False, True, False]
    s = spark.createDataFrame([("log\n0.75\n",), ("oops",), ("  2 ",)], "o string")
    assert [r[0] for r in s.select(C.sandbox_score("o")).collect()] == [0.75, 0.0, 2.0]


def test_curation_helpers(spark):
    df = spark.createDataFrame([("a step #### 42 ", '"why"', "x\nYour Question:\n\nQ?")], "a string, r string, m string")
    r = df.select(
        CU.format_hash_answer("a").alias("f"),
        CU.strip_one_quote("r").alias("q"),
        CU.text_after_marker("m").alias("t"),
        CU.gold_after_hash("a").alias("g"),
    ).first()
    assert r.f == "<think>a step</think>\n<answer>42</answer>" and r.q == "why" and r.t == "Q?" and r.g == "42"
    bad = spark.createDataFrame([("a #### b #### c",)], "a string")
    with pytest.raises(Exception):
        bad.select(CU.format_hash_answer("a")).collect()
    assert bad.select(CU.format_hash_answer("a", on_error="null")).first()[0] == "a #### b #### c"


def test_json_array_source(spark):
    path = scratch_dir(spark, "arr") + ".json"
    import os

    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with open(local, "w", encoding="utf-8") as f:
        f.write('[{"qid": "a", "answer": true}, {"qid": "b", "answer": false}]')
    df = IO.read_json_array(spark, path, "qid string, answer boolean")
    assert [(r.qid, r.answer) for r in df.orderBy("qid").collect()] == [("a", True), ("b", False)]


def test_partition_pruning(spark):
    df = spark.createDataFrame([(i, i % 5, str(i)) for i in range(50)], "problem_id long, contest long, output string")
    path = scratch_dir(spark, "pp")
    IO.write_partitioned(df, path, "contest")
    one = IO.read_partition(spark, path, "contest", 3)
    assert sorted(r.problem_id for r in one.collect()) == [i for i in range(50) if i % 5 == 3]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(contest" in plan and "(contest" in plan
