"""Token-array preparation (T1–T8, A19) as array column expressions.

Token ids are ``array<int>``. Tokenisation itself is a hook (``T1``): any
``Column -> array<int>`` function (e.g. an iterator pandas UDF wrapping a
subword tokenizer); :func:`kiln.operators.tokenize.whitespace_vocabulary_ids`
is the built-in whitespace/vocabulary stand-in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE_INDEX = -100


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# T2
def completion_mask(prompt_len: Column, total_len: Column) -> Column:
    """0 for each prompt token, 1 for each completion token."""
    return F.concat(
        F.array_repeat(F.lit(0), prompt_len.cast("int")),
        F.array_repeat(F.lit(1), F.greatest(total_len - prompt_len, F.lit(0)).cast("int")),
    )


def prefix_matches(prompt_ids: Column | str, full_ids: Column | str) -> Column:
    """T2 warning flag: the tokenised prompt is a prefix of the tokenised prompt+completion."""
    p, f = _c(prompt_ids), _c(full_ids)
    return F.slice(f, 1, F.size(p)) == p


# T3
def mask_labels_before(ids: Column | str, start: Column) -> Column:
    """Labels: −100 for positions before ``start`` (0-based), the id otherwise.

    Built from ``array_repeat`` and ``slice`` (no per-element lambda), so an
    expression passed as ``start`` is evaluated once per row.
    """
    a = _c(ids)
    k = F.least(F.greatest(start, F.lit(0)), F.size(a)).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), k), F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))))


def last_position_of(ids: Column | str, token_id: int | Column) -> Column:
    """0-based position of the last occurrence of a token id (−1 if absent)."""
    t = F.lit(token_id) if isinstance(token_id, int) else token_id
    pos = F.transform(_c(ids), lambda x, i: F.when(x == t, i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(pos), F.lit(-1))


# T4
def pad_to(arr: Column | str, length: int | Column, pad_value: int) -> Column:
    """Right-pad (or cut) an array to exactly ``length`` elements."""
    a = _c(arr)
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(pad_value), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def round_up(length: Column, multiple: int) -> Column:
    return (F.ceil(length / F.lit(multiple)) * F.lit(multiple)).cast("int")


def padded_batch(
    df: DataFrame, batch: str, ids: str, labels: str, masks: Sequence[str] = (), pad_id: int = 0, multiple: int = 1
) -> DataFrame:
    """T4: every row padded to the longest ``ids`` of its batch (rounded up to ``multiple``).

    Ids are padded with ``pad_id``, labels with −100, the given masks with 0, and
    ``attention_mask`` (1 for a token, 0 for padding) is added. The maximum is a
    partial aggregate joined back on the batch, so a batch may span tasks; a null
    batch is a batch, and a null array counts as empty.
    """
    empty = F.array().cast("array<int>")
    own = {c: F.coalesce(F.col(c).cast("array<int>"), empty) for c in (ids, labels, *masks)}
    rows = df.withColumns(own)
    longest = rows.groupBy(F.col(batch).alias("_of")).agg(round_up(F.max(F.size(ids)), multiple).alias("padded_len"))
    rows = rows.join(longest, F.col(batch).eqNullSafe(F.col("_of"))).drop("_of")
    n, length = F.size(ids), F.col("padded_len")
    attention = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))
    rows = rows.withColumn("attention_mask", attention)
    return rows.withColumns(
        {ids: pad_to(ids, length, pad_id), labels: pad_to(labels, length, IGNORE_INDEX)} | {m: pad_to(m, length, 0) for m in masks}
    )


# T5
def truncate(arr: Column | str, max_length: int) -> Column:
    return F.slice(_c(arr), 1, max_length)


def keep_last(arr: Column | str, k: int) -> Column:
    """Left truncation: keep the last k elements."""
    a = _c(arr)
    return F.when(F.size(a) > k, F.slice(a, F.size(a) - F.lit(k - 1), k)).otherwise(a)


# T6
def eos_mask(ids: Column | str, eos_id: int, zero_truncated: bool = False) -> Column:
    """1 up to and including the first EOS, 0 after; no EOS → all 1 (or all 0 if ``zero_truncated``)."""
    a = _c(ids)
    n = F.size(a)
    first = F.array_position(a, F.lit(eos_id)).cast("int")  # 1-based, 0 if absent
    absent = F.array_repeat(F.lit(0 if zero_truncated else 1), n)
    present = F.concat(F.array_repeat(F.lit(1), first), F.array_repeat(F.lit(0), n - first))
    return F.when(first == 0, absent).otherwise(present)


# T8
def stage2_weight(step: Column, total_steps: Column, warmup: float, valid: Column) -> Column:
    """``max(0, 1 - step/(total·warmup))``; warmup < 0 → 1; invalid self-grade → 0.01."""
    if warmup < 0:
        w = F.lit(1.0)
    else:
        w = F.greatest(F.lit(0.0), F.lit(1.0) - step.cast("double") / (total_steps.cast("double") * F.lit(warmup)))
    return F.when(~F.coalesce(valid, F.lit(False)), F.lit(0.01)).otherwise(w)


# A19
def shifted_token_hits(pred_ids: Column | str, labels: Column | str) -> tuple[Column, Column]:
    """(correct, total) with logits shifted by one: pred[i] vs label[i+1], label ≠ −100; (0, 0) without tokens."""
    p, lab = _c(pred_ids), _c(labels)
    n = F.greatest(F.least(F.size(p), F.size(lab)) - F.lit(1), F.lit(0))
    pairs = F.arrays_zip(F.slice(p, 1, n).alias("p"), F.slice(lab, 2, n).alias("l"))
    kept = F.filter(pairs, lambda z: z["l"] != IGNORE_INDEX)
    correct = F.size(F.filter(kept, lambda z: z["p"] == z["l"]))
    return correct, F.size(kept)
