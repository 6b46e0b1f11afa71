"""Per-prompt and per-run statistics.

Group statistics are computed with ``groupBy`` (partial aggregation, so a hot
prompt collapses to one row per map task before the shuffle) and attached back
with an equi-join on the group key. AQE turns that join into a broadcast when
the statistics are small (a runtime size check) and splits skewed partitions
otherwise; a ``Window.partitionBy(prompt)`` would instead put a whole group,
however large, into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ranking import rank_within_groups
from .sizing import broadcast_if_small, join_on_nullable

ZERO_STD_ATOL = 1e-8
ADV_EPS = 1e-4


def _keys(group: str | Sequence[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


# A5
def weighted_reward_sum(rewards: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Σ wᵢ·rᵢ skipping missing rewards; all missing → 0 (``nansum``)."""
    if weights is None:
        weights = [1.0] * len(rewards)
    if len(weights) != len(rewards):
        raise ValueError(f"{len(rewards)} rewards need as many weights, got {len(weights)}")
    total = F.lit(0.0)
    for r, w in zip(rewards, weights):
        total = total + F.coalesce(F.col(r).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return total


# W1 / W2 / A8
def group_advantages(
    df: DataFrame,
    reward: str,
    group: str | Sequence[str] = "prompt_id",
    scale_rewards: bool = True,
    out: str = "advantage",
    size: int | None = None,
) -> DataFrame:
    """Attach group mean, sample std, zero-std flag and the advantage.

    ``advantage = r - mean_g`` (divided by ``std_g + 1e-4`` when scaling).
    A group of one has NULL std and so a NULL scaled advantage. ``size`` is strict
    mode: a group of another number of rows raises :class:`GroupSizeError`.
    """
    keys = _keys(group)
    if size is not None:
        check_group_sizes(df, keys, size)
    stats = df.groupBy(*keys).agg(
        F.avg(reward).alias("group_mean"),
        F.stddev_samp(reward).alias("group_std"),
    )
    j = join_on_nullable(df, stats, keys)
    adv = F.col(reward) - F.col("group_mean")
    if scale_rewards:
        adv = adv / (F.col("group_std") + F.lit(ADV_EPS))
    return j.withColumn("std_is_zero", F.abs(F.col("group_std")) <= F.lit(ZERO_STD_ATOL)).withColumn(out, adv)


def group_reward_metrics(df: DataFrame, reward: str, group: str | Sequence[str] = "prompt_id") -> DataFrame:
    """Mean reward, mean group std and fraction of zero-std groups (one row)."""
    keys = _keys(group)
    g = df.groupBy(*keys).agg(F.avg(reward).alias("m"), F.stddev_samp(reward).alias("s"))
    return g.agg(
        F.avg("m").alias("reward"),
        F.avg("s").alias("reward_std"),
        F.avg(F.when(F.abs(F.col("s")) <= ZERO_STD_ATOL, 1.0).otherwise(0.0)).alias("frac_reward_zero_std"),
    )


# A6 / A7 / A18
def reward_summary(df: DataFrame, rewards: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std, min and max per reward column, NULLs ignored (long form)."""
    long = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("reward_name"), F.col(r).cast("double").alias("value")) for r in rewards])
        ).alias("kv"),
    ).select(*by, "kv.reward_name", "kv.value")
    return long.groupBy(*by, "reward_name").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n"),
    )


# A3 / P7
def pass_rates(df: DataFrame, reward: str, group: str | Sequence[str] = "prompt_id") -> DataFrame:
    """Mean of non-missing rewards per prompt (all missing → NULL)."""
    keys = _keys(group)
    return df.groupBy(*keys).agg(
        F.avg(reward).alias("pass_rate"),
        F.count(F.lit(1)).alias("n_generations"),
        F.count(reward).alias("n_scored"),
    )


def filter_pass_rate(
    rates: DataFrame, min_rate: float = 0.1, max_rate: float = 0.9, col: str = "pass_rate"
) -> DataFrame:
    """Strict band ``min < rate < max``; a NULL rate drops."""
    return rates.filter((F.col(col) > F.lit(min_rate)) & (F.col(col) < F.lit(max_rate)))


# A4 / W1
class GroupSizeError(ValueError):
    """A group does not hold the number of rows that strict mode asks for."""


def check_group_sizes(df: DataFrame, group: str | Sequence[str], size: int) -> DataFrame:
    """Row counts per group (written); a group of another size than ``size`` raises, before any list is built.

    Counts are partial aggregates, so this costs one narrow shuffle whatever a
    group holds; one offending group (the smallest key) is named.
    """
    keys = _keys(group)
    checkpoint_dir(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    worst = counts.filter(F.col("n") != size).agg(F.count(F.lit(1)).alias("bad"), F.min(F.struct(*keys, "n")).alias("first")).first()
    if worst["bad"]:
        found = worst["first"].asDict()
        n = found.pop("n")
        raise GroupSizeError(f"{worst['bad']} groups do not hold {size} rows; {found} holds {n}")
    return counts


def collect_generations(
    df: DataFrame,
    group: str | Sequence[str],
    order: str,
    values: Sequence[str],
    size: int | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """One row per group with ``values`` as arrays in ``order`` (generation order).

    ``size`` is strict mode: every group must hold that many rows, else
    :class:`GroupSizeError`. ``chunk`` bounds a row instead: a group of more rows is
    cut into consecutive runs of ``chunk`` rows, numbered from 0 in a column
    ``chunk``. Only the rows of long groups are ranked, across tasks, so a group
    that holds a third of all rows is never one list. Without either, the group is
    the generations of one prompt, whose number the job configures.
    """
    keys = _keys(group)
    if size is not None:
        check_group_sizes(df, keys, size)
    if chunk is not None:
        df = _numbered_chunks(df, keys, order, chunk)
    by = [*keys, *(["chunk"] if chunk is not None else [])]
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(v) for v in values])))
    g = df.groupBy(*by).agg(packed.alias("_p"))
    return g.select(*by, *[F.transform("_p", _field(v)).alias(f"{v}s") for v in values])


def _numbered_chunks(df: DataFrame, keys: list[str], order: str, chunk: int) -> DataFrame:
    """``df`` with ``chunk``: 0 in groups of up to ``chunk`` rows, else the row's place in its group divided by ``chunk``."""
    checkpoint_dir(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = counts.filter(F.col("_n") > chunk).select(*[F.col(k).alias(f"_long_{k}") for k in keys]).checkpoint(eager=True)
    side, _ = broadcast_if_small(long)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_long_{k}"))
    short = df.join(side, same, "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    ranked = rank_within_groups(df.join(side, same, "left_semi"), keys, [order], out="_rk")
    return short.unionByName(ranked.withColumn("chunk", F.floor((F.col("_rk") - 1) / chunk).cast("long")).drop("_rk"))


def _field(name: str):
    return lambda s: s[name]


# W3
def length_reward(
    df: DataFrame, completion: str, correct: str, scope: str | Sequence[str] = "prompt_id", out: str = "length_reward"
) -> DataFrame:
    """Kimi-style length reward within a scope (default: the prompt group).

    λ = 0.5 − (len − min)/(max − min); correct → λ, wrong → min(0, λ); all the
    same length → 0. ``correct`` NULL (unparseable gold) counts as correct.
    """
    keys = _keys(scope)
    with_len = df.withColumn("_len", F.length(completion))
    mm = with_len.groupBy(*keys).agg(F.min("_len").alias("_min"), F.max("_len").alias("_max"))
    j = join_on_nullable(with_len, mm, keys)
    lam = F.lit(0.5) - (F.col("_len") - F.col("_min")).cast("double") / (F.col("_max") - F.col("_min")).cast("double")
    ok = F.coalesce(F.col(correct), F.lit(True))
    val = F.when(F.col("_max") == F.col("_min"), F.lit(0.0)).when(ok, lam).otherwise(F.least(F.lit(0.0), lam))
    return j.withColumn(out, val).drop("_len", "_min", "_max")


# A9
def completion_length_stats(df: DataFrame, length: str, terminated: str, by: Sequence[str] = ()) -> DataFrame:
    """Length mean/min/max, the same over EOS-terminated rows (0 if none), clipped ratio."""
    L = F.col(length).cast("double")
    t = F.col(terminated)
    n_term = F.count(F.when(t, 1))
    return df.groupBy(*by).agg(
        F.avg(L).alias("mean_length"),
        F.min(L).alias("min_length"),
        F.max(L).alias("max_length"),
        F.coalesce(F.avg(F.when(t, L)), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(F.when(t, L)), F.lit(0.0)).alias("min_terminated_length"),
        F.coalesce(F.max(F.when(t, L)), F.lit(0.0)).alias("max_terminated_length"),
        (F.lit(1.0) - n_term / F.count(F.lit(1))).alias("clipped_ratio"),
    )


# A10
def metric_means(df: DataFrame, step: str = "step", metric: str = "metric", mode: str = "mode", value: str = "value") -> DataFrame:
    """Mean of each logged metric per step; eval-mode names get an ``eval_`` prefix."""
    name = F.when(F.col(mode) == "eval", F.concat(F.lit("eval_"), F.col(metric))).otherwise(F.col(metric))
    return df.groupBy(step, mode, metric).agg(F.avg(value).alias("mean_value")).withColumn("log_name", name)


# W6
def cumulative_by_step(
    df: DataFrame, amount: str, step: str = "step", partition: Sequence[str] = ("mode",), out: str = "cumulative"
) -> DataFrame:
    """Per-step totals of a whole-number column, then a running sum over steps within each partition.

    Totals are pre-aggregated, then summed in the order of (partition, step) by
    range, so a partition with very many steps is spread over many tasks.
    """
    from .tokenize import global_prefix_sum

    keys = list(partition)
    per = df.groupBy(*keys, step).agg(F.sum(amount).cast("long").alias("step_total"))
    cum = global_prefix_sum(per, [*keys, step], "step_total", out="_cum")
    before = cum.groupBy(*keys).agg(F.min_by(F.col("_cum") - F.col("step_total"), F.col(step)).alias("_base"))
    return join_on_nullable(cum, before, keys).withColumn(out, F.col("_cum") - F.col("_base")).drop("_cum", "_base")


# A15
def pass_at_1(df: DataFrame, correct: str, problem: str = "prompt_id", by: Sequence[str] = ()) -> DataFrame:
    """Mean correctness over samples per problem, then over problems."""
    per = df.groupBy(*by, problem).agg(F.avg(F.col(correct).cast("double")).alias("p"))
    return per.groupBy(*by).agg(F.avg("p").alias("pass_at_1"), F.count(F.lit(1)).alias("n_problems"))


# A16
def first_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each group by ``order`` (ties broken by the order columns).

    Uses ``min_by`` on a struct so a hot group is reduced by partial
    aggregation instead of being sorted in one task.
    """
    keys = _keys(group)
    rest = [c for c in df.columns if c not in keys]
    o = F.struct(*[F.col(c) for c in order])
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), o).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# A21
def rows_with_all_rewards_missing(df: DataFrame, rewards: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for r in rewards:
        cond = cond & F.col(r).isNull()
    return df.filter(cond)
