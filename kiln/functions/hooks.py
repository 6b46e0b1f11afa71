"""User extension points (X1–X4): named rewards, formatting functions,
reward models and generators.

Hooks that run user Python code use Arrow-batched pandas UDFs
(``pandas_udf`` / ``mapInPandas``) so the JVM ↔ Python hop is per batch,
never per row. Built-in rewards stay JVM-side column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewards import reward_registry

_USER_REWARDS: dict[str, Callable[..., Column]] = {}


# X1
def register_reward(name: str, fn: Callable[..., Column]) -> None:
    """Add a reward by name: ``fn(completion, solution, **cols) -> Column``."""
    _USER_REWARDS[name] = fn


def get_rewards(names: list[str], **params) -> list[Callable[..., Column]]:
    reg = {**reward_registry(**params), **_USER_REWARDS}
    missing = [n for n in names if n not in reg or reg[n] is None]
    if missing:
        raise KeyError(f"unknown or scope-dependent reward(s): {missing}")
    return [reg[n] for n in names]


def python_reward(fn: Callable[[pd.Series, pd.Series], pd.Series], rows: int = 256) -> Callable[..., Column]:
    """Wrap a vectorised pandas function ``(completions, solutions) -> rewards`` as a reward.

    ``fn`` gets up to ``rows`` rows at once, numbered from 0, whatever the size of Spark's batches.
    Missing rewards are NaN/None in pandas and become SQL NULL.
    """

    def in_slices(c: pd.Series, s: pd.Series) -> pd.Series:
        # Lists of words and the like, which ``fn`` makes of every text, are held for one slice at a time.
        cuts = range(0, len(c), rows) or [0]
        parts = [fn(c.iloc[i : i + rows].reset_index(drop=True), s.iloc[i : i + rows].reset_index(drop=True)) for i in cuts]
        return pd.concat([p.astype("float64") for p in parts], ignore_index=True)

    udf = F.pandas_udf(in_slices, "double")

    def reward(completion, solution=None, **kw):
        sol = solution if solution is not None else F.lit(None).cast("string")
        return F.nanvl(udf(F.col(completion) if isinstance(completion, str) else completion, sol), F.lit(None).cast("double"))

    return reward


# X2
def formatting_func(fn: Callable[[Column], Column]) -> Callable[[DataFrame, str, str], DataFrame]:
    """``example -> text`` as a Column function applied to a DataFrame."""

    def apply(df: DataFrame, col: str, out: str = "text") -> DataFrame:
        return df.withColumn(out, fn(F.col(col)))

    return apply


# X3
def reward_model(score_batch: Callable[[pd.Series], pd.Series], batch_size: int = 64) -> Callable[[Column], Column]:
    """Model-based reward: an iterator pandas UDF so the model loads once per task."""

    @F.pandas_udf("double")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for i in range(0, len(b), batch_size):
                out.append(score_batch(b.iloc[i : i + batch_size]).astype("float64"))
            yield pd.concat(out) if out else pd.Series([], dtype="float64")

    return lambda text: _score(text)


# X4
def generate_once_per_prompt(
    df: DataFrame,
    prompt: str,
    generate: Callable[[pd.DataFrame], pd.DataFrame],
    out_schema: str,
) -> DataFrame:
    """Run a user generator over distinct prompts only, then join results back.

    ``generate`` gets a pandas frame with a ``prompt`` column and returns rows
    of ``out_schema`` (which must include ``prompt``); rows it drops are
    dropped from the output too (a failed generation removes the row).
    """
    prompts = df.select(prompt).distinct().withColumnRenamed(prompt, "prompt")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield generate(pdf)

    gen = prompts.mapInPandas(run, schema=out_schema).withColumnRenamed("prompt", prompt)
    return df.join(gen, prompt, "inner")
