"""Curation text columns and chat messages.

Messages are ``array<struct<role: string, content: string>>`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, py_strip

MESSAGE_TYPE = "array<struct<role:string,content:string>>"

# ---------------------------------------------------------------------------
# Fixed values shared with the reference's data contract.
# ---------------------------------------------------------------------------
QUESTION_MARKER = "Your Question:\n\n"
OPTIONS_MARKER = "\nOptions: "
ANSWER_SEPARATOR = "####"
EVALUATION_CUE = "\n<evaluation>"
TAG_RENAMES = (("<thinking>", "<think>"), ("</thinking>", "</think>"), ("<answering>", "<answer>"), ("</answering>", "</answer>"))
CHATML_START, CHATML_END = "<|im_start|>", "<|im_end|>"


def message(role: str | Column, content: Column | str) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), col_of(content).alias("content"))


def messages(*msgs: Column) -> Column:
    return F.array(*msgs)


# C1
def normalize_tags(c: Column | str) -> Column:
    x = col_of(c)
    for old, new in TAG_RENAMES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


# C2
def text_after_marker(c: Column | str, marker: str = QUESTION_MARKER) -> Column:
    """Second piece after splitting on the marker (NULL if the marker is absent)."""
    x = col_of(c)
    return F.when(F.instr(x, marker) > 0, F.split_part(x, F.lit(marker), F.lit(2)))


# C3
def split_reasoning_answer(c: Column | str, on_error: str = "raise") -> tuple[Column, Column]:
    """``reasoning #### result`` → (reasoning, result), both stripped.

    No separator → (NULL, NULL) and callers keep the text as is. More than one
    separator is an error in the source data: ``on_error="raise"`` fails the
    job (as the reference does), ``"null"`` yields NULLs for that row.
    """
    x = col_of(c)
    parts = F.split(x, ANSWER_SEPARATOR)
    n = F.size(parts)
    bad = n > 2
    if on_error == "raise":
        guard = F.when(bad, F.raise_error(F.concat(F.lit("more than one '####' in answer: "), F.substring(x, 1, 80))))
        reasoning = F.coalesce(guard, F.when(n == 2, py_strip(F.get(parts, 0))))
        result = F.coalesce(guard, F.when(n == 2, py_strip(F.get(parts, 1))))
    else:
        reasoning = F.when(n == 2, py_strip(F.get(parts, 0)))
        result = F.when(n == 2, py_strip(F.get(parts, 1)))
    return reasoning, result


def tagged_answer(reasoning: Column, result: Column) -> Column:
    """``<think>reasoning</think>\\n<answer>result</answer>``."""
    return F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n<answer>"), result, F.lit("</answer>"))


def format_hash_answer(c: Column | str, on_error: str = "raise") -> Column:
    """C3 + formatting: tagged answer when the text has ``####``, else the text."""
    reasoning, result = split_reasoning_answer(c, on_error)
    return F.when(result.isNotNull(), tagged_answer(reasoning, result)).otherwise(col_of(c))


# R4
def gold_after_hash(c: Column | str) -> Column:
    return py_strip(F.split_part(col_of(c), F.lit(ANSWER_SEPARATOR), F.lit(2)))


def gold_choice(c: Column | str) -> Column:
    return F.lower(py_strip(col_of(c)))


# C4
def strip_one_quote(c: Column | str) -> Column:
    """Drop one leading and one trailing double quote."""
    return F.regexp_replace(F.regexp_replace(col_of(c), '^"', ""), '"$', "")


# C5
def question_with_options(problem: Column | str, options: Column | str) -> Column:
    return F.concat(col_of(problem), F.lit(OPTIONS_MARKER), col_of(options))


def problem_from_question(c: Column | str) -> Column:
    return F.substring_index(col_of(c), OPTIONS_MARKER, 1)


# C10
def fill_template(template: str, prompt: Column | str) -> Column:
    return F.replace(F.lit(template), F.lit("{prompt}"), col_of(prompt))


# C11
def prompt_messages(user: Column | str, system: str | Column | None = None) -> Column:
    u = message("user", user)
    if system is None:
        return F.array(u)
    return F.array(message("system", system if isinstance(system, Column) else F.lit(system)), u)


# C12
def render_chatml(msgs: Column | str, add_generation_prompt: bool = False) -> Column:
    """ChatML text: ``<|im_start|>role\\ncontent<|im_end|>\\n`` per message."""
    body = F.array_join(
        F.transform(
            col_of(msgs),
            lambda m: F.concat(F.lit(CHATML_START), m["role"], F.lit("\n"), m["content"], F.lit(CHATML_END + "\n")),
        ),
        "",
    )
    if add_generation_prompt:
        body = F.concat(body, F.lit(CHATML_START + "assistant\n"))
    return body


# C13
def append_eos(c: Column | str, eos: str) -> Column:
    x = col_of(c)
    return F.when(x.endswith(eos), x).otherwise(F.concat(x, F.lit(eos)))


# C15
def keep_roles(msgs: Column | str, roles=("system", "user")) -> Column:
    return F.filter(col_of(msgs), lambda m: m["role"].isin(*roles))


def with_assistant(msgs: Column | str, content: Column | str) -> Column:
    return F.concat(keep_roles(msgs), F.array(message("assistant", content)))


# C16
def evaluation_cue(rendered: Column | str, end_markers=(CHATML_END + "\n", CHATML_END)) -> Column:
    """Drop a trailing end-of-turn marker (first matching kind), then append ``\\n<evaluation>``."""
    x = col_of(rendered)
    out = None
    for mk in end_markers:
        cut = F.substring(x, F.lit(1), F.length(x) - F.lit(len(mk)))
        out = F.when(x.endswith(mk), cut) if out is None else out.when(x.endswith(mk), cut)
    return F.concat(out.otherwise(x), F.lit(EVALUATION_CUE))


# C17
def with_assistant_prefill(prompt: Column | str, completion: Column | str) -> Column:
    """If the prompt's last turn is an assistant turn, prefix its content to the completion."""
    last = F.try_element_at(col_of(prompt), F.lit(-1))
    return F.when(last["role"] == "assistant", F.concat(last["content"], col_of(completion))).otherwise(
        col_of(completion)
    )
