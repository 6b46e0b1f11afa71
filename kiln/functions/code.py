"""Code-answer columns: extraction, code format, test status, sandbox score
parsing, source patching, stop-string truncation (R15, R16, R31–R34, C18)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, let, py_strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
# Status by substring of the judge feedback, checked in this order.
STATUS_BY_FEEDBACK = (
    ("Compilation error", "CE"),
    ("Memory limit exceeded", "MLE"),
    ("Time limit exceeded", "TLE"),
    ("Output isn't correct", "WA"),
)
# Worst status first.
STATUS_PRIORITY = {"CE": -1, "RE": 0, "WA": 1, "MLE": 2, "TLE": 3, "PA": 4, "AC": 5, "SKIPPED": 999}
PYTHON_LANGS = ("python", "python3", "Python 3", "PyPy 3", "PyPy 3-64")
CPP_HEADER = "#include <bits/stdc++.h>\n"
USING_STD = "\nusing namespace std;\n\n"
# What Python 3 moved or renamed (text to look for, text to write).
PYTHON_RENAMES = (
    ("import imp", "import importlib"),
    ("asyncio.async(", "asyncio.ensure_future("),
    ("inspect.getargspec", "inspect.getfullargspec"),
    ("array.array('c'", "array.array('b'"),
)
ABSTRACT_COLLECTIONS = (
    "Mapping", "Sequence", "Set", "Container", "MutableMapping", "MutableSet", "MutableSequence",
)
# Lines added after the last import (what a submission must contain, what makes it needless, the lines).
MATH_IMPORTS = (
    ("fractions.gcd", "import math", "\nimport math"),
    ("gcd", "from math import gcd", "\nfrom math import gcd"),
)
NO_DIGIT_LIMIT = "\nimport sys\nsys.set_int_max_str_digits(0)"
# ---------------------------------------------------------------------------
# Python ``str.splitlines`` boundaries.
_LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _lang_regex(language: Column | str) -> Column:
    lang = F.lit(language) if isinstance(language, str) else language
    return F.concat(F.lit(r"\Q"), lang, F.lit(r"\E"))


# R15
def extract_code(completion: Column | str, language: Column | str | None = "python") -> Column:
    """Body of the last ```` ```<language>\\n … ``` ```` block; "" if none or no language."""
    if language is None:
        return F.lit("")
    pat = F.concat(F.lit("(?s)```"), _lang_regex(language), F.lit(r"\n(.*?)```"))
    last = F.try_element_at(F.regexp_extract_all(col_of(completion), pat, F.lit(1)), F.lit(-1))
    out = F.coalesce(last, F.lit(""))
    if not isinstance(language, str):
        out = F.when(language.isNull(), F.lit("")).otherwise(out)
    return out


# R16
def code_format_reward(completion: Column | str, language: Column | str = "python") -> Column:
    pat = F.concat(
        F.lit(r"(?s)(?m)(?d)\A<think>.*?</think><answer>.*?```"),
        _lang_regex(language),
        F.lit(r".*?```.*?</answer>$"),
    )
    m = F.regexp(col_of(completion), pat)
    return F.when(m, F.lit(1.0)).otherwise(F.lit(0.0))


# R31
def test_status(score: Column, feedback: Column) -> Column:
    fb = F.coalesce(feedback, F.lit(""))
    zero = None
    for needle, code in STATUS_BY_FEEDBACK:
        cond = F.instr(fb, needle) > 0
        zero = F.when(cond, F.lit(code)) if zero is None else zero.when(cond, F.lit(code))
    zero = zero.otherwise(F.lit("RE"))
    return F.when(score == 0.0, zero).when(score == 1.0, F.lit("AC")).otherwise(F.lit("PA"))


def status_priority(status: Column) -> Column:
    out = None
    for k, v in STATUS_PRIORITY.items():
        out = F.when(status == k, F.lit(v)) if out is None else out.when(status == k, F.lit(v))
    return out


# R32
def sandbox_score(stdout: Column | str) -> Column:
    """Last line of the stripped output as a number, else the whole text, else 0."""
    s = py_strip(col_of(stdout))
    last = F.try_element_at(F.split(s, "\n"), F.lit(-1))
    return F.coalesce(_number(py_strip(last)), _number(s), F.lit(0.0))


def _number(c: Column) -> Column:
    """A decimal literal (also nan and inf) as double; a type suffix as in ``5d`` is no number."""
    literal = r"(?i)\A[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?|nan|inf|infinity)\z"
    return F.when(c.rlike(literal), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


# R34
def truncate_at(c: Column | str, stop: str, keep_stop: bool = True) -> Column:
    """Cut a text at the first ``stop`` string (kept by default); unchanged if absent."""
    x = col_of(c)
    head = F.substring_index(x, stop, 1)
    cut = F.concat(head, F.lit(stop)) if keep_stop else head
    return F.when(F.instr(x, stop) > 0, cut).otherwise(x)


# C18
def contest_id(problem_id: Column | str) -> Column:
    """``"1234/A"`` → ``"1234"``; integer ids zero-padded to at least 4 digits."""
    head = F.split_part(col_of(problem_id), F.lit("/"), F.lit(1))
    number = head.try_cast("int")
    return F.when(number.isNotNull(), F.format_string("%04d", number))


# R33
def _call(*tokens: str) -> str:
    """Pattern of a call whose tokens may stand apart."""
    return r"\s*".join(re.escape(t) for t in tokens)


def _import_list_without(name: str, after: Column) -> Column:
    """What follows ``from m import``: its list of names without ``name`` (NULL if no other name is left).

    The list ends with the bracket it opens with, or else with its line. A
    list that does not hold ``name`` is left as it is.
    """
    bracketed = F.ltrim(after).startswith("(") & F.contains(after, F.lit(")"))
    open_at = F.when(bracketed, F.instr(after, "(")).otherwise(0)
    inside = F.substring(after, F.instr(after, "(") + 1, F.instr(after, ")") - F.instr(after, "(") - 1)
    listed = F.when(bracketed, inside).otherwise(F.regexp_extract(after, r"\A[^\n;#]*", 0))
    names = F.split(listed, ",")
    others = F.filter(names, lambda n: py_strip(n) != name)
    found = F.struct(bracketed.alias("brackets"), open_at.alias("open"), listed.alias("listed"), F.size(names).alias("n"), others.alias("others"))

    def without(x: Column) -> Column:
        kept = F.array_join(x["others"], ",")
        # A name that moves up to the word "import" keeps a blank before it.
        kept = F.when(~x["brackets"] & ~kept.rlike(r"\A\s"), F.concat(F.lit(" "), kept)).otherwise(kept)
        rest = F.substring(after, F.length(x["listed"]) + x["open"] + 1, F.length(after))
        new = F.concat(F.substring(after, F.lit(1), x["open"]), kept, rest)
        none_left = F.forall(x["others"], lambda n: py_strip(n) == "")
        gone = F.when(x["brackets"], F.substring(rest, 2, 1 << 30)).otherwise(rest)
        return F.when(F.size(x["others"]) == x["n"], F.struct(F.lit(True).alias("stays"), after.alias("text"))).otherwise(
            F.struct((~none_left).alias("stays"), F.when(none_left, gone).otherwise(new).alias("text"))
        )

    return let(found, without)


def _drop_imported(code: Column, module: str, name: str) -> Column:
    """``from module import ...`` statements without ``name``; a statement that imports nothing else goes."""
    head = r"from\s+" + re.escape(module) + r"\s+import\b"
    heads = F.regexp_extract_all(code, F.lit(head), F.lit(0))
    pieces = F.split(code, head)
    after = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: _import_list_without(name, p))
    put = F.zip_with(heads, after, lambda h, p: F.concat(F.when(p["stays"], h).otherwise(""), p["text"]))
    return F.concat(F.element_at(pieces, 1), F.array_join(put, ""))


def _added_imports(code: Column) -> Column:
    """The import lines a submission lacks."""
    math = None
    for found, needless, lines in MATH_IMPORTS:
        lacks = F.contains(code, F.lit(found)) & ~F.contains(code, F.lit(needless))
        math = F.when(lacks, lines) if math is None else math.when(lacks, lines)
    return F.concat(math.otherwise(""), F.when(F.contains(code, F.lit("set_int_max_str_digits")), "").otherwise(NO_DIGIT_LIMIT))


def _python_patch(code: Column) -> Column:
    """Python 3 fixes: the imports a submission lacks, then moved and renamed names.

    The added lines stand behind the last import line (the first line, if nothing
    is imported), and that line is repeated behind them, as submissions are
    patched upstream.
    """
    pieces = F.split(code, _LINE_BREAK)
    lines = F.slice(pieces, 1, F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0))

    def imports(line: Column) -> Column:
        bare = py_strip(line)
        return bare.startswith("import") | (bare.startswith("from") & F.contains(bare, F.lit("import")))

    def with_imports(x: Column) -> Column:
        return F.transform(
            x["lines"], lambda line, i: F.when(i == x["last"], F.concat(line, x["added"], F.lit("\n"), line)).otherwise(line)
        )

    def placed(split_once: Column) -> Column:
        last = F.array_max(F.transform(split_once, lambda line, i: F.when(imports(line), i).otherwise(0)))
        return let(F.struct(split_once.alias("lines"), last.alias("last"), _added_imports(code).alias("added")), with_imports)

    out = F.array_join(let(lines, placed), "\n")
    moved = [(f"from collections import {n}", f"from collections.abc import {n}") for n in ABSTRACT_COLLECTIONS]
    for old, new in (*moved, *PYTHON_RENAMES):
        out = F.replace(out, F.lit(old), F.lit(new))
    # A continued line goes on with the next line that is not empty.
    out = F.regexp_replace(out, r"(?<=\\)\n+", "\n")
    for tokens in (("os", ".", "getlogin", "(", ")"), ("getlogin", "(", ")")):
        out = F.regexp_replace(out, _call(*tokens), "False")
    out = F.regexp_replace(out, r"\b" + re.escape("fractions.gcd") + r"\b", "math.gcd")
    return F.rtrim(let(out, lambda patched: _drop_imported(patched, "fractions", "gcd")), F.lit("\\"))


def _cpp_patch(code: Column, problem_id: Column | None = None) -> Column:
    header = F.lit(CPP_HEADER)
    if problem_id is not None:
        inc = F.concat(F.lit('#include "'), problem_id, F.lit('.h"'))
        header = F.concat(header, F.when(F.instr(code, inc) == 0, F.concat(inc, F.lit("\n"))).otherwise(F.lit("")))
    std = F.when((F.instr(code, "using namespace std;") == 0) & (F.instr(code, "std::") == 0), F.lit(USING_STD))
    return F.concat(header, F.coalesce(std, F.lit("")), code)


def patch_code(code: Column | str, language: Column | str) -> Column:
    """Route a submission to the Python rewrites or the C++ header insertion."""
    x = col_of(code)
    lang = F.lit(language) if isinstance(language, str) else language
    is_py = lang.isin(*PYTHON_LANGS)
    is_cpp = (F.instr(lang, "cpp") > 0) | (F.instr(lang, "C++") > 0)
    return (
        F.when(x.isNull() | (x == ""), x)
        .when(is_py, _python_patch(x))
        .when(is_cpp, _cpp_patch(x))
        .otherwise(x)
    )


def add_includes(code: Column | str, problem_id: Column) -> Column:
    """IOI: bits header, the problem header, and ``using namespace std``."""
    x = col_of(code)
    return F.when(x.isNull() | (x == ""), x).otherwise(_cpp_patch(x, problem_id))
