"""Curation joins and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewards as R
from ..functions.curation import gold_after_hash, normalize_tags, text_after_marker
from ..sources.io import write_jsonl
from .sizing import measured_join


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep, per key, the row with the largest ``order`` (dict semantics: last wins).

    ``max_by`` over a struct is a partial aggregation, so a key repeated by a
    third of the rows costs one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def join_gold(rows: DataFrame, gold: DataFrame, on: str, gold_order: str, strict: bool = True) -> DataFrame:
    """Look up each row's gold record by a text key (duplicate keys: last wins).

    ``strict`` raises (like a missing dict key) when some row has no gold; without
    it such a row stays with NULL gold columns.
    """
    g = dedupe_last(gold, on, gold_order)
    if strict:
        missing = rows.join(g.select(on), on, "left_anti").limit(1).count()
        if missing:
            raise KeyError(f"rows without a gold record on {on!r}")
    # Gold tables are usually far smaller than the responses: measured broadcast.
    return measured_join(rows, g, on, "left")


def join_checked(left: DataFrame, right: DataFrame, on: str, left_col: str, right_col: str) -> DataFrame:
    """Equi-join on an id and keep the pair only if a second field agrees.

    Adds ``fields_agree``; callers assert it or filter on it.
    """
    j = left.join(right, on, "inner")
    return j.withColumn("fields_agree", F.col(left_col) == F.col(right_col))


def teacher_stats(responses: DataFrame, response: str = "response", pure_answer: str = "pure_answer") -> DataFrame:
    """R19/R21/R22 on teacher output: accuracy, strict format_all, self-grade list, agreement."""
    resp = F.col(response)
    lst = R.parse_reward_list(resp)
    valid = lst.isNotNull() & ~F.exists(lst, lambda v: v.isNull() | (v < 0))
    acc = R.accuracy_reward(resp, F.col(pure_answer), gold_is_tagged=False)
    fmt = R.format_all_reward(resp)
    out = responses.withColumn("stat_accuracy_reward", acc).withColumn("stat_format_all_reward", fmt)
    out = out.withColumn("stat_rewarding_reward", F.when(valid, lst).otherwise(F.array().cast("array<double>")))
    return out.withColumn(
        "stat_rewrew_right",
        R.rewrew_right(F.col("stat_rewarding_reward"), F.col("stat_accuracy_reward"), F.col("stat_format_all_reward")),
    )


def curate_teacher_output(raw: DataFrame, gold: DataFrame, strict: bool = True) -> DataFrame:
    """3.3 pipeline: question from the request text, gold join, tag normalisation, stats.

    ``raw``: ``index, request_text, response``; ``gold``: ``index, question, answer``.
    """
    rows = raw.select(
        F.col("index").alias("request_index"),
        text_after_marker("request_text").alias("question"),
        normalize_tags("response").alias("response"),
    )
    g = gold.select(F.col("index").alias("gold_index"), "question", "answer")
    j = join_gold(rows, g, "question", "gold_index", strict=strict)
    j = j.withColumn("pure_answer", gold_after_hash("answer"))
    return teacher_stats(j)


def totals(stats: DataFrame) -> DataFrame:
    """A1: totals of accuracy, format and self-grade agreement over N."""
    return stats.agg(
        F.sum(F.coalesce(F.col("stat_accuracy_reward"), F.lit(0.0))).alias("accuracy_total"),
        F.sum("stat_format_all_reward").cast("long").alias("format_total"),
        F.count(F.when(F.col("stat_rewrew_right"), 1)).alias("rewrew_total"),
        F.count(F.lit(1)).alias("n"),
    )


def select_experiments(df: DataFrame, exp: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """P10: keep experiments whose name starts with an included prefix and no excluded one."""
    cond = F.lit(True)
    if include:
        inc = F.lit(False)
        for p in include:
            inc = inc | F.col(exp).startswith(p)
        cond = cond & inc
    for p in exclude:
        cond = cond & ~F.col(exp).startswith(p)
    return df.filter(cond)


def experiment_accuracy(generated: DataFrame, gold: DataFrame, correct: Column, exp: str = "exp", key: str = "index") -> DataFrame:
    """J7 + A2: join each experiment's rows to gold on ``key``; accuracy ×100 (2 decimals).

    Experiments whose row count differs from the gold row count are skipped.
    """
    n_gold = gold.count()
    j = measured_join(generated, gold, key, "inner").withColumn("_ok", correct.cast("double"))
    per = generated.groupBy(exp).agg(F.count(F.lit(1)).alias("n_rows"))
    acc = j.groupBy(exp).agg(F.bround(F.avg(F.coalesce("_ok", F.lit(0.0))) * 100, 2).alias("accuracy"))
    return per.filter(F.col("n_rows") == F.lit(n_gold)).join(acc, exp, "inner")


def missing_evaluation(df: DataFrame, response: str = "response") -> DataFrame:
    """Rows whose response lacks an ``<evaluation>`` tag."""
    return df.filter(~F.col(response).contains("<evaluation>"))


def preview(df: DataFrame, long_col: str = "response", n: int = 200) -> DataFrame:
    """A response cut at n characters with ``...`` appended when longer."""
    c = F.col(long_col)
    return df.withColumn(long_col, F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c))


def dataset_preview(df: DataFrame, order: str, long_col: str = "response", n: int = 200) -> DataFrame:
    """Number of rows, field names, and the first row (by ``order``) with its long field cut; one row.

    The first row is a partial ``min_by`` over a struct, so nothing is sorted. Null
    orders come last; an empty table gives 0 rows, its fields and a null first row.
    """
    rest = [F.col(c) for c in df.columns]
    at = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("at"))
    return preview(df, long_col, n).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(*[F.lit(c) for c in df.columns]).alias("fields"),
        F.min_by(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), at).alias("first_row"),
    )


def single_value(df: DataFrame, col: str) -> bool:
    """Whether ``col`` holds exactly one distinct value (reads at most two)."""
    return df.select(col).distinct().limit(2).count() == 1


def assert_single_value(df: DataFrame, col: str, what: str = "language") -> None:
    """Raise when rows disagree on ``col`` (the enforce-same-language option)."""
    if not single_value(df, col):
        raise ValueError(f"All rows must have the same {what}")


# P3
def rename_if_present(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a column only when it exists (e.g. ``sft_completion`` → ``completion``)."""
    return df.withColumnRenamed(old, new) if old in df.columns else df


# P5
def keep_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keep only the listed fields, in the listed order."""
    return df.select(*fields)


# P8
BACKUP_SUFFIX = "__original"


def backup_column(df: DataFrame, col: str) -> DataFrame:
    """Keep a copy of ``col`` before it is overwritten (e.g. prompt → chat messages)."""
    return df.withColumn(col + BACKUP_SUFFIX, F.col(col))


def restore_column(df: DataFrame, col: str) -> DataFrame:
    """Put the backed-up value back into ``col`` and drop the copy."""
    return df.withColumn(col, F.col(col + BACKUP_SUFFIX)).drop(col + BACKUP_SUFFIX)


# SNK4
def batch_request_rows(
    df: DataFrame, order: str, question: str, split: str, system: str, template: str, max_tokens: int
) -> DataFrame:
    """Batch-API request rows: ``custom_id = <split>_%06d`` in ``order``, ``body.messages``, ``max_tokens``.

    Ids come from an exact distributed row number (no single-task window).
    """
    from ..functions.curation import fill_template, prompt_messages
    from .ranking import global_row_number

    r = global_row_number(df, [order], out="_rn")
    msgs = prompt_messages(fill_template(template, F.col(question)), system)
    return r.select(
        F.concat(F.lit(split + "_"), F.lpad((F.col("_rn") - 1).cast("string"), 6, "0")).alias("custom_id"),
        F.struct(msgs.alias("messages")).alias("body"),
        F.lit(max_tokens).alias("max_tokens"),
    )


def write_batch_requests(requests: DataFrame, path: str, max_per_file: int = 50_000) -> None:
    """SNK4: request rows as JSON lines, in files of at most ``max_per_file`` requests (a batch API's limit)."""
    write_jsonl(requests, path, max_records_per_file=max_per_file)
