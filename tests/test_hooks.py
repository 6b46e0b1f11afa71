"""User extension points: named rewards, reward models, generators, formatting functions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kiln.functions import hooks as H


def _len_reward(c: pd.Series, s: pd.Series) -> pd.Series:
    return c.str.len().astype("float64").where(c.str.len() > 3)


def test_named_python_reward_and_missing(spark):
    H.register_reward("char_len", H.python_reward(_len_reward))
    (fn,) = H.get_rewards(["char_len"])
    df = spark.createDataFrame([("abcd", "x"), ("ab", "x")], "c string, s string")
    assert [r[0] for r in df.select(fn("c", F.col("s"))).collect()] == [4.0, None]
    with pytest.raises(KeyError):
        H.get_rewards(["no_such_reward"])
    assert len(H.get_rewards(["length"])) == 1


def test_reward_model_batches(spark):
    seen = []

    def score(texts: pd.Series) -> pd.Series:
        seen.append(len(texts))
        return texts.str.count("a").astype("float64")

    model = H.reward_model(score, batch_size=2)
    df = spark.createDataFrame([("aa",), ("ba",), ("c",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(model(F.col("t"))).collect()] == [2.0, 1.0, 0.0]


def test_generate_once_per_prompt(spark):
    def gen(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = pdf[pdf["prompt"] != "drop"]
        return pd.DataFrame({"prompt": keep["prompt"], "out": keep["prompt"].str.upper()})

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "drop")], "id int, prompt string")
    out = H.generate_once_per_prompt(df, "prompt", gen, "prompt string, out string")
    assert sorted((r.id, r.out) for r in out.collect()) == [(1, "A"), (2, "A")]


def test_formatting_func(spark):
    fmt = H.formatting_func(lambda c: F.concat(F.lit("Q: "), c))
    df = spark.createDataFrame([("x",)], "q string")
    assert fmt(df, "q").first().text == "Q: x"
