"""Per-completion evaluation report text.

The report lists one line per reward (accuracy, format, tag count), joined by
a separator picked per row from a seeded hash, and ends with a summary line
when every reward is perfect. The format check and tag counts here are the
newline-strict variants used by the report, which differ from R6/R10.
Accuracy uses the row's own solution (the reference's version names an
undefined variable and so always reports a failed evaluation).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewards import extract_answer
from .text import col_of, count_occurrences

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's report text.
# ---------------------------------------------------------------------------
REPORT_SEPARATORS = ("\n", "\n---\n", "\n\n", " | ", "\n• ")
PERFECT_SUMMARY = "All rewards are 1.0"
STRICT_FORMAT_PATTERN = r"(?s)(?m)(?d)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>$"
STRICT_TAGS = ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>")
ARROW = " → "
REWARD = "reward="
MATCH_STATUS = ("evaluation_failed", "match", "mismatch")
ACCURACY_LINES = ("accuracy evaluation:\n  - Model output: ", "\n  - Expected: ", "\n  - Match status: ", "\n  → reward=")
FORMAT_LINE = ("format: think=", ", answer=", ", valid=")
TAG_COUNT_LINE = ("tag_count: <think>=", ", </think>=", ", <answer>=", ", </answer>=")
TAG_NAMES = ("<think>", "</think>", "<answer>", "</answer>")
ALL_TAGS_LINE, MISSING_TAGS_LINE = "tag_count: all tags present", "tag_count: missing tags "
# ---------------------------------------------------------------------------


def _filled(texts: Sequence[str], values: Sequence[Column]) -> Column:
    """Each fixed text followed by its value."""
    return F.concat(*[x for t, v in zip(texts, values, strict=True) for x in (F.lit(t), v)])


def num_text(c: Column) -> Column:
    """Python ``str()`` of an optional float: ``1.0``, ``0.25``, ``None``."""
    return F.coalesce(c.cast("double").cast("string"), F.lit("None"))


def bool_text(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


# R28
def match_status(reward: Column) -> Column:
    failed, match, mismatch = map(F.lit, MATCH_STATUS)
    return F.when(reward.isNull(), failed).when(reward == 1.0, match).otherwise(mismatch)


def report_accuracy(completion: Column | str, solution: Column | str) -> tuple[Column, Column]:
    """(reward, text). Reward is NULL when the gold or the answer cannot be extracted."""
    gold = extract_answer(solution)
    pred = extract_answer(completion)
    reward = F.when((F.length(gold) == 0) | (F.length(pred) == 0), F.lit(None).cast("double")).otherwise(
        F.when(pred == gold, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    shown_pred = F.when((F.length(gold) > 0) & (F.length(pred) > 0), pred).otherwise(F.lit("None"))
    shown_gold = F.when(F.length(gold) > 0, gold).otherwise(F.lit("None"))
    return reward, _filled(ACCURACY_LINES, [shown_pred, shown_gold, match_status(reward), num_text(reward)])


# R26
def report_format(completion: Column | str) -> tuple[Column, Column]:
    x = col_of(completion)
    has_think = (F.instr(x, "<think>") > 0) & (F.instr(x, "</think>") > 0)
    has_answer = (F.instr(x, "<answer>") > 0) & (F.instr(x, "</answer>") > 0)
    valid = F.regexp(x, F.lit(STRICT_FORMAT_PATTERN))
    reward = F.when(valid, F.lit(1.0)).otherwise(F.lit(0.0))
    shown = [bool_text(c) for c in (has_think, has_answer, valid)]
    return reward, F.concat(_filled(FORMAT_LINE, shown), F.lit(ARROW + REWARD), num_text(reward))


def strict_tag_counts(completion: Column | str) -> list[Column]:
    return [count_occurrences(completion, t) for t in STRICT_TAGS]


def report_tag_count(completion: Column | str) -> tuple[Column, Column]:
    counts = strict_tag_counts(completion)
    reward = F.lit(0.0)
    for c in counts:
        reward = reward + F.when(c == 1, F.lit(0.25)).otherwise(F.lit(0.0))
    shown = [c.cast("string") for c in counts]
    return reward, F.concat(_filled(TAG_COUNT_LINE, shown), F.lit(ARROW + REWARD), num_text(reward))


# R27
def missing_tags_report(completion: Column | str) -> Column:
    counts = strict_tag_counts(completion)
    reward, _ = report_tag_count(completion)
    missing = F.array_compact(F.array(*[F.when(c != 1, F.lit(n)) for c, n in zip(counts, TAG_NAMES)]))
    said = F.when(F.size(missing) == 0, F.lit(ALL_TAGS_LINE)).otherwise(F.concat(F.lit(MISSING_TAGS_LINE), F.array_join(missing, ", ")))
    return F.concat(said, F.lit(ARROW + REWARD), num_text(reward))


# R25
def report_other(name: str, reward: Column) -> Column:
    """The line of any other reward function: its name and its value."""
    return F.concat(F.lit(f"{name}: {REWARD}"), num_text(reward))


def separator_index(seed: int, key: Column) -> Column:
    """Seeded per-row pick in ``0..len(REPORT_SEPARATORS)-1`` (md5 prefix, portable)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(len(REPORT_SEPARATORS))).cast("int")


# R25
def evaluation_report(
    completion: Column | str, solution: Column | str, key: Column, seed: int = 0, others: Mapping[str, Column] | None = None
) -> Column:
    """Full report: accuracy, format and tag-count lines, one for each of ``others``, separator, perfect summary.

    A missing or negative reward ("reward=None", "reward=-0.5") does not break the
    perfect check, as in the reference: it only reads numbers without a sign.
    """
    acc, acc_t = report_accuracy(completion, solution)
    fmt, fmt_t = report_format(completion)
    tag, tag_t = report_tag_count(completion)
    seps = F.array(*[F.lit(s) for s in REPORT_SEPARATORS])
    sep = F.element_at(seps, separator_index(seed, key) + 1)
    body = F.concat_ws("", acc_t, sep, fmt_t, sep, tag_t)
    perfect = (acc.isNull() | (acc == 1.0)) & (fmt == 1.0) & (tag == 1.0)
    for name, reward in (others or {}).items():
        body = F.concat(body, sep, report_other(name, reward))
        perfect = perfect & (reward.isNull() | (reward < 0) | (reward == 1.0))
    return F.when(perfect, F.concat(body, F.lit("\n" + PERFECT_SUMMARY))).otherwise(body)


def evaluation_summary(completion: Column | str, solution: Column | str) -> Column:
    """``accuracy = 1.0, format = 0.0, tag_count = 0.75`` (the short form)."""
    acc, _ = report_accuracy(completion, solution)
    fmt, _ = report_format(completion)
    tag, _ = report_tag_count(completion)
    return F.concat(
        F.lit("accuracy = "), num_text(acc), F.lit(", format = "), num_text(fmt), F.lit(", tag_count = "), num_text(tag)
    )
