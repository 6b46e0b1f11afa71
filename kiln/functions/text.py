"""Text helpers shared by rewards, decontamination and curation.

All helpers are built-in Spark expressions, so they stay inside the JVM and
whole-stage codegen where Spark supports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.split()`` / ``str.strip()`` whitespace: Java's Unicode white
# space plus the four information separators U+001C..U+001F.
WS_CLASS = r"[\s\x1c-\x1f]"
WS_RUN = r"(?U)" + WS_CLASS + "+"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), 0)


def py_strip(c: Column | str) -> Column:
    """``str.strip()`` with no argument: trim Unicode whitespace at both ends."""
    return F.regexp_replace(col_of(c), r"(?U)^" + WS_CLASS + r"+|" + WS_CLASS + r"+$", "")


def split_words(c: Column | str, lower: bool = True) -> Column:
    """``text.lower().split()``: whitespace-separated words, no empty pieces."""
    x = F.lower(col_of(c)) if lower else col_of(c)
    return F.array_remove(F.split(x, WS_RUN), "")


def normalize_text(c: Column | str) -> Column:
    """Lower case, collapse whitespace runs to one space, strip the ends."""
    return F.array_join(split_words(c, lower=True), " ")


def word_ngrams(words: Column | str, n: int) -> Column:
    """Word n-grams (joined by one space) of a word array; fewer than n words → empty.

    Pass the *name* of a column holding the words (computed once in an
    earlier projection) for the fastest plan: the lambda then reads an
    attribute. A Column expression is accepted too; it is expanded as n
    shifted slices zipped together, so the words expression is evaluated a
    fixed number of times per row instead of once per position.
    """
    empty = F.array().cast("array<string>")
    if isinstance(words, str):
        w = F.col(words)
        size = F.size(w)
        first = F.slice(w, 1, F.greatest(size - F.lit(n - 1), F.lit(0)))
        # The words of a gram are named one by one: no array is copied for each place.
        grams = F.transform(first, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))
        return F.when(size >= n, grams).otherwise(empty)
    size = F.size(words)
    slices = [F.slice(words, i + 1, F.greatest(size - F.lit(n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)]
    fields = [f"w{i}" for i in range(n)]
    grams = F.transform(F.arrays_zip(*slices), lambda s: F.concat_ws(" ", *[s[f] for f in fields]))
    return F.when(size >= n, grams).otherwise(empty)


def count_occurrences(c: Column | str, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring (``str.count``)."""
    x = col_of(c)
    return ((F.length(x) - F.length(F.replace(x, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def first_between(c: Column | str, open_tag: str, close_tag: str) -> Column:
    """Text of the first ``open … close`` pair (DOTALL, non-greedy); "" if none."""
    pat = "(?s)" + _q(open_tag) + "(.*?)" + _q(close_tag)
    return F.regexp_extract(col_of(c), pat, 1)


def last_between(c: Column | str, open_tag: str, close_tag: str) -> Column:
    """Text of the last ``open … close`` pair (DOTALL, non-greedy); NULL if none."""
    pat = "(?s)" + _q(open_tag) + "(.*?)" + _q(close_tag)
    return F.try_element_at(F.regexp_extract_all(col_of(c), F.lit(pat), 1), F.lit(-1))


def _q(s: str) -> str:
    """Quote a literal for a Java regex."""
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$|?*+()[]{}\/" else ch)
    return "".join(out)


quote_regex = _q
