"""Training-record formatters (F1–F13) and system prompts (C14).

SFT records: ``prompt`` (system + user messages) and ``completion`` (one
assistant message). RFT records: ``prompt``, ``sft_completion`` and
``solution``; records built from teacher data add ``rewrew_valid`` and
``taer_response``. The system prompts are our own wording; only the tag
contract they describe (think / answer / evaluation / reward) matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curation import format_hash_answer, message, tagged_answer

_TA = (
    "Reason about the problem step by step inside <think> </think>, then give only the final answer "
    "inside <answer> </answer>."
)
_TAER = (
    _TA + " After the answer, judge your own work inside <evaluation> </evaluation> and finish with "
    "<reward>[a, f]</reward>, where a is 1 if you believe the answer is correct (else 0) and f is 1 if "
    "you followed this format (else 0)."
)
SYSTEM_PROMPTS = {
    ("gsm8k", "ta"): "You solve grade-school math word problems. " + _TA,
    ("gsm8k", "taer"): "You solve grade-school math word problems. " + _TAER,
    ("strategyqa", "ta"): "You answer yes/no questions; the answer must be True or False. " + _TA,
    ("strategyqa", "taer"): "You answer yes/no questions; the answer must be True or False. " + _TAER,
    ("mathqa", "ta"): "You solve multiple-choice math problems; answer with the option letter. " + _TA,
    ("mathqa", "taer"): "You solve multiple-choice math problems; answer with the option letter. " + _TAER,
}


def _prompt(family: str, kind: str, question: Column) -> Column:
    return F.array(message("system", F.lit(SYSTEM_PROMPTS[(family, kind)])), message("user", question))


def _sft(df: DataFrame, prompt: Column, completion: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, prompt.alias("prompt"), F.array(message("assistant", completion)).alias("completion"))


def _rft(df: DataFrame, prompt: Column, solution: Column, keep: list[str], teacher: bool) -> DataFrame:
    cols = [*keep, prompt.alias("prompt"), F.array(message("assistant", solution)).alias("sft_completion"), solution.alias("solution")]
    if teacher:
        cols += [F.col("stat_rewrew_right").alias("rewrew_valid"), F.col("response").alias("taer_response")]
    return df.select(*cols)


def bool_answer_text(answer: Column) -> Column:
    return F.when(answer, F.lit("True")).otherwise(F.lit("False"))


# F1 / F2: question, answer ("reasoning #### result")
def gsm8k_sft(df: DataFrame, keep=()) -> DataFrame:
    return _sft(df, _prompt("gsm8k", "ta", F.col("question")), format_hash_answer("answer"), list(keep))


def gsm8k_rft(df: DataFrame, keep=()) -> DataFrame:
    return _rft(df, _prompt("gsm8k", "taer", F.col("question")), format_hash_answer("answer"), list(keep), False)


# Question, answer, response (+ stat_rewrew_right)
def gsm8k_teacher_sft(df: DataFrame, keep=()) -> DataFrame:
    return _sft(df, _prompt("gsm8k", "taer", F.col("question")), F.col("response"), list(keep))


def gsm8k_teacher_rft(df: DataFrame, using_prompt: str = "taer", keep=()) -> DataFrame:
    return _rft(df, _prompt("gsm8k", using_prompt, F.col("question")), format_hash_answer("answer"), list(keep), True)


# Question, answer (bool), facts (array<string>)
def _facts_answer() -> Column:
    return tagged_answer(F.array_join("facts", " "), bool_answer_text(F.col("answer")))


def strategyqa_sft(df: DataFrame, keep=()) -> DataFrame:
    return _sft(df, _prompt("strategyqa", "ta", F.col("question")), _facts_answer(), list(keep))


def strategyqa_rft(df: DataFrame, keep=()) -> DataFrame:
    # The reference leaves plain bool-QA RFT unimplemented; this is its teacher-free twin.
    return _rft(df, _prompt("strategyqa", "taer", F.col("question")), _facts_answer(), list(keep), False)


# F7 / F8
def strategyqa_teacher_sft(df: DataFrame, keep=()) -> DataFrame:
    return _sft(df, _prompt("strategyqa", "taer", F.col("question")), F.col("response"), list(keep))


def strategyqa_teacher_rft(df: DataFrame, using_prompt: str = "taer", keep=()) -> DataFrame:
    return _rft(df, _prompt("strategyqa", using_prompt, F.col("question")), _facts_answer(), list(keep), True)


# Question (with options), answer, rationale
def _rationale_answer() -> Column:
    return tagged_answer(F.col("rationale"), F.col("answer"))


def mathqa_sft(df: DataFrame, keep=()) -> DataFrame:
    return _sft(df, _prompt("mathqa", "ta", F.col("question")), _rationale_answer(), list(keep))


def mathqa_rft(df: DataFrame, keep=()) -> DataFrame:
    return _rft(df, _prompt("mathqa", "taer", F.col("question")), _rationale_answer(), list(keep), False)


# F11 / F12
def mathqa_teacher_sft(df: DataFrame, keep=()) -> DataFrame:
    return _sft(df, _prompt("mathqa", "taer", F.col("question")), F.col("response"), list(keep))


def mathqa_teacher_rft(df: DataFrame, using_prompt: str = "taer", keep=()) -> DataFrame:
    return _rft(df, _prompt("mathqa", using_prompt, F.col("question")), _rationale_answer(), list(keep), True)


# F13
def formatter_for(dataset_name: str | None, datatype: str = "rft", fmt: str | None = None) -> Callable | None:
    """Pick a formatter by dataset-name substring (teacher variants, with ``_``, first).

    ``fmt`` names the family explicitly (needed for mixtures, which have no
    single dataset name). Unknown names → None (no formatting).
    """
    name = fmt or dataset_name or ""
    table = [
        ("gsm8k_", {"rft": gsm8k_teacher_rft, "sft": gsm8k_teacher_sft}),
        ("gsm8k", {"rft": gsm8k_rft, "sft": gsm8k_sft}),
        ("strategyqa_", {"rft": strategyqa_teacher_rft, "sft": strategyqa_teacher_sft}),
        ("strategyqa", {"rft": strategyqa_rft, "sft": strategyqa_sft}),
        ("mathqa_", {"rft": mathqa_teacher_rft, "sft": mathqa_teacher_sft}),
        ("mathqa", {"rft": mathqa_rft, "sft": mathqa_sft}),
    ]
    for needle, fns in table:
        if needle in name:
            if datatype not in fns:
                raise ValueError(f"unknown datatype {datatype!r}")
            return fns[datatype]
    return None
