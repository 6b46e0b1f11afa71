"""Reward columns.

Every reward is ``f(completion: Column, …) -> Column``; missing rewards are
SQL NULL (never NaN), so aggregates skip them the way ``nanmean`` does.
No model text is ever evaluated: reward lists are parsed as JSON (R20).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mathnorm import math_equal
from .text import col_of, count_occurrences, first_between, last_between, py_strip, split_words, word_ngrams

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# Tag names and the regular expressions of the format / step rewards.
# (Java syntax; ``\A`` because the reference anchors with ``re.match``.)
# ---------------------------------------------------------------------------
FORMAT_PATTERN = r"(?s)\A<think>.*?</think>\n?<answer>.*?</answer>"
FORMAT_ALL_PATTERN = (
    r"(?s)\A<think>.*?</think>\n?<answer>.*?</answer>\n?<evaluation>.*?</evaluation>\n?<reward>.*?</reward>"
)
REASONING_STEPS_PATTERN = r"(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"
TAGS = ("<think>", "</think>", "<answer>", "</answer>")
BINARY_THRESHOLD = 0.99
# Cosine reward factory defaults: min/max wrong, min/max correct, max length.
COSINE_DEFAULTS = (-1.0, -0.5, 0.5, 1.0, 1000)


def _d(x) -> Column:
    return F.lit(x).cast("double")


# R1
def extract_answer(c: Column | str, mode: str = "first") -> Column:
    """Text inside ``<answer>…</answer>`` (first or last pair), stripped; "" if none."""
    if mode == "first":
        raw = first_between(c, "<answer>", "</answer>")
    elif mode == "last":
        raw = F.coalesce(last_between(c, "<answer>", "</answer>"), F.lit(""))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return py_strip(raw)


# R2
def verify_exact(pred: Column, gold: Column) -> Column:
    return py_strip(pred) == py_strip(gold)


# R3
def parse_bool_answer(c: Column | str) -> Column:
    """``true``/``false`` (any case, stripped) → boolean; anything else → NULL."""
    x = F.lower(py_strip(col_of(c)))
    return F.when(x == "true", F.lit(True)).when(x == "false", F.lit(False))


def verify_bool(pred_text: Column | str, gold: Column | str) -> Column:
    """Boolean answer equals the boolean gold; an unparseable answer is wrong."""
    return F.coalesce(parse_bool_answer(pred_text) == col_of(gold), F.lit(False))


# R5
def accuracy_reward(completion: Column | str, solution: Column | str, gold_is_tagged: bool = True) -> Column:
    """1.0 / 0.0 for an exact answer match; NULL when the gold has no answer.

    ``gold_is_tagged``: gold is parsed with R1 (rollout tables); else the gold
    column already holds the pure answer (teacher tables).
    """
    gold = extract_answer(solution) if gold_is_tagged else col_of(solution)
    pred = extract_answer(completion)
    return F.when(F.length(gold) == 0, F.lit(None).cast("double")).otherwise(
        F.when(verify_exact(pred, gold), _d(1.0)).otherwise(_d(0.0))
    )


# R9
def count_formats(c: Column | str) -> Column:
    x = col_of(c)

    def pair(o, cl):
        return F.when((count_occurrences(x, o) == 1) & (count_occurrences(x, cl) == 1), _d(0.25)).otherwise(_d(0.0))

    return pair("<think>", "</think>") + pair("<answer>", "</answer>")


# R6 / R7
def format_reward(completion: Column | str, soft: bool = False) -> Column:
    m = col_of(completion).rlike(FORMAT_PATTERN)
    if soft:
        return count_formats(completion) + F.when(m, _d(0.5)).otherwise(_d(0.0))
    return F.when(m, F.lit(1)).otherwise(F.lit(0))


# R8
def format_all_reward(completion: Column | str, soft: bool = False) -> Column:
    m = col_of(completion).rlike(FORMAT_ALL_PATTERN)
    if soft:
        return count_formats(completion) + F.when(m, _d(0.5)).otherwise(_d(0.0))
    return F.when(m, F.lit(1)).otherwise(F.lit(0))


# R10
def tag_count_reward(completion: Column | str) -> Column:
    x = col_of(completion)
    out = _d(0.0)
    for t in TAGS:
        out = out + F.when(count_occurrences(x, t) == 1, _d(0.25)).otherwise(_d(0.0))
    return out


# R11
def reasoning_steps_reward(completion: Column | str) -> Column:
    n = F.regexp_count(col_of(completion), F.lit(REASONING_STEPS_PATTERN))
    return F.least(_d(1.0), n.cast("double") / F.lit(3.0))


# R12
def cosine_scaled_reward(
    completion: Column | str,
    correct: Column,
    min_value_wrong: float = COSINE_DEFAULTS[0],
    max_value_wrong: float = COSINE_DEFAULTS[1],
    min_value_correct: float = COSINE_DEFAULTS[2],
    max_value_correct: float = COSINE_DEFAULTS[3],
    max_len: int = COSINE_DEFAULTS[4],
) -> Column:
    """Cosine length schedule; ``correct`` NULL means unparseable gold → 1.0.

    Wrong answers swap the bounds (min = max_wrong, max = min_wrong), as the
    reference does. Lengths past ``max_len`` are not clamped.
    """
    length = F.length(col_of(completion)).cast("double")
    cosine = F.cos(length / F.lit(float(max_len)) * F.lit(math.pi))
    lo = F.when(correct, _d(min_value_correct)).otherwise(_d(max_value_wrong))
    hi = F.when(correct, _d(max_value_correct)).otherwise(_d(min_value_wrong))
    val = lo + F.lit(0.5) * (hi - lo) * (F.lit(1.0) + cosine)
    return F.when(correct.isNull(), _d(1.0)).otherwise(val)


def math_correct(completion: Column | str, solution: Column | str) -> Column:
    """Correctness used by cosine/length rewards (R29 numeric subset)."""
    return math_equal(completion, solution)


# R13 / R14
def repetition_penalty_reward(
    completion: Column | str,
    ngram_size: int,
    max_penalty: float,
    language: str = "en",
    segmenter: Callable[[Column], Column] | None = None,
) -> Column:
    """``(1 - distinct/total n-grams) * max_penalty``; empty or short text → 0.

    ``language="en"`` splits lower-cased text on whitespace. Any other language
    needs a ``segmenter`` hook (Column of text → Column array<string>), e.g. a
    pandas UDF wrapping a word segmenter; none is bundled.
    """
    if max_penalty > 0:
        raise ValueError(f"the penalty must be zero or less, got {max_penalty}")
    x = col_of(completion)
    if language == "en":
        words = split_words(x, lower=True)
    elif segmenter is not None:
        words = segmenter(x)
    else:
        raise ValueError(
            f"pass a segmenter (Column -> array<string>) for texts in {language!r}"
        )
    total = F.size(words) - F.lit(ngram_size - 1)
    distinct = F.size(F.array_distinct(word_ngrams(words, ngram_size)))
    scaled = (F.lit(1.0) - distinct.cast("double") / total.cast("double")) * F.lit(float(max_penalty))
    return (
        F.when(x == "", _d(0.0))
        .when(F.size(words) < ngram_size, _d(0.0))
        .otherwise(scaled)
    )


def with_repetition_penalty(
    df,
    text: str,
    ngram_size: int,
    max_penalty: float,
    out: str = "repetition_penalty",
    segmenter: Callable[[Column], Column] | None = None,
):
    """DataFrame form of R13 / R14: words are computed once in their own projection.

    Without a ``segmenter`` the lower-cased text is split on whitespace.
    """
    if max_penalty > 0:
        raise ValueError(f"the penalty must be zero or less, got {max_penalty}")
    w = df.withColumn("_rp_words", segmenter(F.col(text)) if segmenter else split_words(text, lower=True))
    total = F.size("_rp_words") - F.lit(ngram_size - 1)
    distinct = F.size(F.array_distinct(word_ngrams("_rp_words", ngram_size)))
    scaled = (F.lit(1.0) - distinct.cast("double") / total.cast("double")) * F.lit(float(max_penalty))
    val = (
        F.when(F.col(text) == "", _d(0.0))
        .when(F.size("_rp_words") < ngram_size, _d(0.0))
        .otherwise(scaled)
    )
    return w.withColumn(out, val).drop("_rp_words")


# R17
def soft_overlong_punishment(length: Column, max_completion_len: int, soft_punish_cache: int) -> Column:
    """DAPO soft overlong penalty from a completion length (e.g. ``size(ids)``)."""
    free = max_completion_len - soft_punish_cache
    return (
        F.when(length <= F.lit(free), _d(0.0))
        .when(length <= F.lit(max_completion_len), (F.lit(free) - length).cast("double") / F.lit(float(soft_punish_cache)))
        .otherwise(_d(-1.0))
    )


# R20
def parse_reward_list(c: Column | str) -> Column:
    """Last ``<reward>…</reward>`` body parsed as a JSON list of numbers; NULL if not."""
    body = py_strip(last_between(c, "<reward>", "</reward>"))
    whole = body.rlike(r"(?s)\A\[[^\[\]]*\]\z")
    return F.when(whole, F.from_json(body, "array<double>", {"allowNonNumericNumbers": "false"}))


def _list_ok(p: Column, length: int | None, reject_negative: bool) -> Column:
    ok = p.isNotNull() & ~F.exists(p, lambda v: v.isNull())
    if length is not None:
        ok = ok & (F.size(p) == length)
    if reject_negative:
        ok = ok & ~F.exists(p, lambda v: v < 0)
    return ok


# R18
def rewarding_reward(completion: Column | str, solution: Column | str, zero_zero: str = "reference") -> Column:
    """Reward for the self-grade ``<reward>[acc, fmt]</reward>``.

    Ground truth is ``[accuracy or 0, format or 0]``. Score is
    ``1 - mean(|gt - pred| / max(gt, pred))``; an invalid list (not JSON, not
    two numbers, a negative) scores 0. ``zero_zero="reference"`` keeps the
    reference's behaviour that a 0/0 term makes the whole score 0;
    ``"match"`` treats 0/0 as an exact match.
    """
    if zero_zero not in ("reference", "match"):
        raise ValueError("zero_zero must be 'reference' or 'match'")
    gt1 = F.coalesce(accuracy_reward(completion, solution), _d(0.0))
    gt2 = format_reward(completion).cast("double")
    p = parse_reward_list(completion)
    ok = _list_ok(p, 2, True)
    p1, p2 = F.get(p, 0), F.get(p, 1)
    m1, m2 = F.greatest(gt1, p1), F.greatest(gt2, p2)

    def term(g, pr, m):
        if zero_zero == "match":
            return F.when(m == 0, _d(0.0)).otherwise(F.abs(g - pr) / m)
        return F.abs(g - pr) / m

    score = F.lit(1.0) - (term(gt1, p1, m1) + term(gt2, p2, m2)) / F.lit(2.0)
    bad = ~ok
    if zero_zero == "reference":
        bad = bad | (m1 == 0) | (m2 == 0)
    return F.when(bad, _d(0.0)).otherwise(score)


# R19 / R21
def rewarding_reward_raw(completion: Column | str, solution: Column | str, reject_negative: bool = True) -> Column:
    """``struct<gt: array<double>, dt: array<double>, valid: boolean>``.

    The think/answer part is cut at the first ``<evaluation>``; the reward list
    is read from the whole text. Invalid rows carry only ``valid = false``.
    """
    x = col_of(completion)
    cut = F.when(F.instr(x, "<evaluation>") > 0, F.substring_index(x, "<evaluation>", 1)).otherwise(x)
    acc = F.coalesce(accuracy_reward(cut, solution), _d(0.0))
    acc = F.when(acc.isin(0.0, 1.0), acc).otherwise(F.round(acc, 2))
    fmt = format_reward(cut).cast("double")
    p = parse_reward_list(x)
    valid = _list_ok(p, 2, reject_negative)
    return F.struct(
        F.when(valid, F.array(acc, fmt)).alias("gt"),
        F.when(valid, p).alias("dt"),
        valid.alias("valid"),
    )


# R22
def rewrew_right(reward_list: Column, accuracy: Column, format_all: Column) -> Column:
    """Self-grade list has exactly two values equal to (accuracy, format_all)."""
    ok = (F.size(reward_list) == 2) & (F.get(reward_list, 0) == accuracy) & (F.get(reward_list, 1) == format_all)
    return F.coalesce(ok, F.lit(False))


# R23
def binary_reward(score: Column) -> Column:
    return F.when(score.isNull(), _d(None)).when(score > BINARY_THRESHOLD, _d(1.0)).otherwise(_d(0.0))


# W3 by name; on whole tables operators.groups.length_reward needs no window.
def length_reward(completion: Column | str, correct: Column, scope: Column | str) -> Column:
    """Length reward within ``scope`` as one column; a window over the scope's generations."""
    from pyspark.sql import Window

    n = F.length(col_of(completion))
    group = Window.partitionBy(col_of(scope))
    low, high = F.min(n).over(group), F.max(n).over(group)
    share = F.lit(0.5) - F.try_divide((n - low).cast("double"), (high - low).cast("double"))
    value = F.when(F.coalesce(correct, F.lit(True)), share).otherwise(F.least(F.lit(0.0), share))
    return F.when(high == low, F.lit(0.0)).otherwise(value)


# R15/R16 live in functions.code.


def reward_registry(**params) -> dict[str, Callable[..., Column]]:
    """Reward name → ``f(completion, solution, **cols) -> Column``.

    Code rewards score test-result tables (see ``kiln.operators.grading``); they
    are listed so a name lookup never fails, and take the per-row score column.
    """
    from .code import code_format_reward

    cos = params.get("cosine", COSINE_DEFAULTS)
    rep_n = params.get("repetition_n_grams", 3)
    rep_max = params.get("repetition_max_penalty", -1.0)
    code_lang = params.get("code_language", "python")
    max_len = params.get("max_completion_len", 16384)
    cache = params.get("soft_punish_cache", 4096)
    return {
        "accuracy": lambda completion, solution=None, **kw: accuracy_reward(completion, solution),
        "format": lambda completion, solution=None, **kw: format_reward(completion).cast("double"),
        "format_all": lambda completion, solution=None, **kw: format_all_reward(completion).cast("double"),
        "rewrew": lambda completion, solution=None, **kw: rewarding_reward(completion, solution),
        "reasoning_steps": lambda completion, solution=None, **kw: reasoning_steps_reward(completion),
        "cosine": lambda completion, solution=None, **kw: cosine_scaled_reward(
            completion, math_correct(completion, solution), *cos
        ),
        "repetition_penalty": lambda completion, solution=None, **kw: repetition_penalty_reward(
            completion, rep_n, rep_max
        ),
        "length": lambda completion, solution=None, scope="prompt_id", **kw: length_reward(
            completion, math_correct(completion, solution), scope
        ),
        "code": lambda completion=None, solution=None, score=None, **kw: score,
        "binary_code": lambda completion=None, solution=None, score=None, **kw: binary_reward(score),
        "ioi_code": lambda completion=None, solution=None, score=None, **kw: score,
        "cf_code": lambda completion=None, solution=None, score=None, **kw: score,
        "code_format": lambda completion, solution=None, language=None, **kw: code_format_reward(
            completion, language if language is not None else F.lit(code_lang)
        ),
        "tag_count": lambda completion, solution=None, **kw: tag_count_reward(completion),
        "soft_overlong_punishment": lambda completion=None, solution=None, completion_ids=None, **kw: (
            soft_overlong_punishment(F.size(completion_ids), max_len, cache)
        ),
    }
