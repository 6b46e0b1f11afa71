"""Golden values for the reward columns (own cases, expected values computed from the definitions)."""

import math

import pytest
from pyspark.sql import functions as F

from kiln.functions import rewards as R
from kiln.functions.text import normalize_text, py_strip, split_words, word_ngrams

from .conftest import one_col


def _vals(df, col):
    if isinstance(col, int):
        return [r[col] for r in df.collect()]
    return [r[0] for r in df.select(col).collect()]


def _penalty(text, n, worst):
    """Share of repeated n-word windows times the worst penalty."""
    words = text.lower().split()
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    return (1 - len(set(windows)) / len(windows)) * worst if windows else 0.0


@pytest.mark.parametrize(
    "text",
    [
        "",
        "kettle",
        "green kettle",
        "rain fell on the quiet harbour all night",
        "go go go go go go",
        "left right left right left",
        "P Q R P Q R P Q R",
        "p Q r s P q R s",
        "salt and pepper then salt and pepper then bread",
    ],
)
@pytest.mark.parametrize("n,worst", [(2, -1.0), (3, -0.4), (3, -2.5)])
def test_repetition_penalty(spark, text, n, worst):
    df = one_col(spark, [text])
    col_form = _vals(df.select(R.repetition_penalty_reward("c", n, worst).alias("r")), "r")[0]
    frame_form = _vals(R.with_repetition_penalty(df, "c", n, worst), "repetition_penalty")[0]
    assert col_form == pytest.approx(_penalty(text, n, worst), abs=1e-9)
    assert frame_form == pytest.approx(_penalty(text, n, worst), abs=1e-9)


def test_repetition_mixed_case_and_errors(spark):
    df = one_col(spark, ["Blue Door blue DOOR", "blue door BLUE door"])
    a, b = _vals(df.select(R.repetition_penalty_reward("c", 2, -1.0)), 0)
    assert a == b
    with pytest.raises(ValueError):
        R.repetition_penalty_reward("c", 2, 1.0)
    with pytest.raises(ValueError):
        R.repetition_penalty_reward("c", 2, -1.0, language="zh")


@pytest.mark.parametrize(
    "text,markers",
    [
        ("Step 1: boil water\nStep 2: add rice\nStep 3: wait\nStep 4: eat", 4),
        ("First, weigh the flour.\nNext, sift it.", 2),
        ("Step 1: weigh the flour", 1),
        ("\n- milk\n* eggs", 2),
        ("flour, milk and eggs go into one bowl", 0),
    ],
)
def test_reasoning_steps(spark, text, markers):
    v = _vals(one_col(spark, [text]).select(R.reasoning_steps_reward("c")), 0)[0]
    assert v == pytest.approx(min(1.0, markers / 3))


TAGS = ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>")


@pytest.mark.parametrize("present", [(1, 1, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0)])
def test_tag_count(spark, present):
    text = "".join((tag if there else " ") + word for tag, there, word in zip(TAGS, present, ("two plus five", "", "seven", "")))
    assert _vals(one_col(spark, [text]).select(R.tag_count_reward("c")), 0)[0] == sum(present) / 4


def test_format_rewards(spark):
    ok = "<think>\nI count:\n1. a\n2. b\n</think>\n<answer>\n9\n</answer>"
    later = "intro\n<think>x</think><answer>y</answer>"
    full = "<think>a</think>\n<answer>b</answer>\n<evaluation>c</evaluation>\n<reward>[1,1]</reward>"
    df = one_col(spark, [ok, later, full])
    assert _vals(df.select(R.format_reward("c")), 0) == [1, 0, 1]
    assert _vals(df.select(R.format_all_reward("c")), 0) == [0, 0, 1]
    assert _vals(df.select(R.format_reward("c", soft=True)), 0) == [1.0, 0.5, 1.0]


def test_overlong(spark):
    df = spark.createDataFrame([(5,), (12,), (9,)], "n int")
    v = _vals(df.select(R.soft_overlong_punishment(F.col("n"), 10, 2)), 0)
    assert v == [0.0, -1.0, -0.5]


@pytest.mark.parametrize("answer,right", [("5/8", True), ("3/8", False)])
@pytest.mark.parametrize("length", [30, 60, 90])
def test_cosine(spark, answer, right, length):
    """Half a cosine over the length, from the best to the worst value of its kind."""
    text = (r"so \boxed{\frac{%s}{%s}}" % tuple(answer.split("/"))).ljust(length)
    wave = (1 + math.cos(math.pi * length / 100)) / 2
    want = 0.2 + (0.9 - 0.2) * wave if right else -0.3 + (-0.8 + 0.3) * wave
    df = spark.createDataFrame([(text, r"\frac{5}{8}")], "c string, s string")
    got = df.select(R.cosine_scaled_reward("c", R.math_correct("c", "s"), -0.8, -0.3, 0.2, 0.9, 100)).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_accuracy_and_rewrew(spark):
    sol = "<answer>7</answer>"
    rows = [
        ("<think>a</think>\n<answer> 7 </answer>\n<evaluation>e</evaluation>\n<reward>[1,1]</reward>", 1.0, 1.0),
        ("<think>a</think>\n<answer>6</answer>\n<reward>[1,1]</reward>", 0.0, 0.5),
        ("<think>a</think>\n<answer>6</answer>\n<reward>[0,1]</reward>", 0.0, 0.0),  # 0/0 quirk
        ("<think>a</think>\n<answer>7</answer>\n<reward>(1,1)</reward>", 1.0, 0.0),  # not JSON
        ("no tags", 0.0, 0.0),
    ]
    df = spark.createDataFrame([(c, sol) for c, _, _ in rows], "c string, s string")
    out = df.select(
        R.accuracy_reward("c", "s").alias("a"),
        R.rewarding_reward("c", "s").alias("rr"),
        R.rewarding_reward("c", "s", zero_zero="match").alias("rm"),
    ).collect()
    assert [r.a for r in out] == [e for _, e, _ in rows]
    assert [r.rr for r in out] == [e for _, _, e in rows]
    assert out[2].rm == 1.0
    empty_gold = spark.createDataFrame([("x", "no answer tag")], "c string, s string")
    assert empty_gold.select(R.accuracy_reward("c", "s")).first()[0] is None


def test_binary_and_bool(spark):
    df = spark.createDataFrame([(0.995,), (0.5,), (None,)], "s double")
    assert _vals(df.select(R.binary_reward(F.col("s"))), 0) == [1.0, 0.0, None]
    b = spark.createDataFrame([(" TRUE ", True), ("false", True), ("maybe", False)], "p string, g boolean")
    assert _vals(b.select(R.verify_bool("p", "g")), 0) == [True, False, False]


def test_text_helpers(spark):
    df = one_col(spark, ["  Hello  World\x1c!\t", "a b c d"])
    assert _vals(df.select(py_strip("c")), 0)[0] == "Hello  World\x1c!"
    assert _vals(df.select(normalize_text("c")), 0)[0] == "hello world !"
    w = df.select(split_words("c").alias("w"))
    grams = _vals(w.select(word_ngrams("w", 2)), 0)
    grams_expr = _vals(df.select(word_ngrams(split_words("c"), 2)), 0)
    assert grams == grams_expr
    assert grams[1] == ["a b", "b c", "c d"]
    assert math.isclose(len(grams[0]), 2)
