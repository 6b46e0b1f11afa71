"""Numeric-subset math answer equivalence as column expressions.

The reference calls an external LaTeX/symbolic parser. We keep the part that
is a plain column job: pick the answer text (last closed ``\\boxed{…}``, else the first ``<answer>…</answer>``, else the whole text), drop
``$``, ``\\left``/``\\right``, ``\\!`` and whitespace, rewrite ``\\frac{a}{b}`` /
``\\dfrac{a}{b}`` to ``a/b``, then compare numerically (with tolerance) when
both sides are numbers or simple fractions, and as strings otherwise.
Symbolic algebra is out of scope; a user can pass their own ``equal`` column
(e.g. from a pandas UDF) wherever a correctness column is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, first_between, py_strip

_BOX = "\\boxed{"
# Pieces of a text: the start of a box, a brace, or a run without either.
_PIECE = r"\\boxed\{|[{}]|[^{}\\]++|\\"
_FRAC = r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}"
_NUM_FRAC = r"^(-?[0-9]+(?:\.[0-9]+)?)/(-?[0-9]+(?:\.[0-9]+)?)$"


def last_boxed(x: Column) -> Column:
    """Content of the last ``\\boxed{…}`` that is closed (braces nest to any depth); NULL if none.

    Read from the right, a box is closed if a closing brace is still unmatched.
    Two folds with a few counters as state, so linear in the text.
    """

    def from_right(a: Column, piece: Column) -> Column:
        opens = piece.isin("{", _BOX)
        return F.struct(
            (a["closers"] + F.when(piece == "}", 1).when(opens & (a["closers"] > 0), -1).otherwise(0)).alias("closers"),
            (a["chars"] + F.length(piece)).alias("chars"),
            F.when((a["found"] < 0) & (piece == _BOX) & (a["closers"] > 0), a["chars"]).otherwise(a["found"]).alias("found"),
        )

    start = F.struct(F.lit(0).alias("closers"), F.lit(0).alias("chars"), F.lit(-1).alias("found"))
    pieces = F.regexp_extract_all(x, F.lit(_PIECE), 0)
    after = F.aggregate(F.reverse(pieces), start, from_right)["found"]
    tail = F.when(after > 0, F.substring(x, F.length(x) - after + 1, after))

    def from_left(a: Column, piece: Column) -> Column:
        depth = a["depth"] + F.when(piece == "}", -1).when(piece.isin("{", _BOX), 1).otherwise(0)
        inside = (a["depth"] > 0) & (depth > 0)
        return F.struct(
            F.when(a["depth"] > 0, depth).otherwise(0).alias("depth"),
            (a["chars"] + F.when(inside, F.length(piece)).otherwise(0)).alias("chars"),
        )

    inner = F.aggregate(
        F.regexp_extract_all(tail, F.lit(_PIECE), 0), F.struct(F.lit(1).alias("depth"), F.lit(0).alias("chars")), from_left
    )["chars"]
    return F.substring(tail, F.lit(1), inner)


def answer_text(c: Column | str) -> Column:
    """The answer span of a model text or a gold solution."""
    x = col_of(c)
    boxed = F.when(F.instr(x, _BOX) > 0, last_boxed(x))
    tagged = first_between(x, "<answer>", "</answer>")
    return F.coalesce(boxed, F.when(F.instr(x, "<answer>") > 0, tagged), x)


def normalize_math(c: Column | str) -> Column:
    x = py_strip(col_of(c))
    x = F.regexp_replace(x, r"\\left|\\right|\\!|\$", "")
    x = F.regexp_replace(x, _FRAC, "$1/$2")
    x = F.regexp_replace(x, r"\s+", "")
    return x


def to_number(c: Column) -> Column:
    """Number value of a normalised answer: decimal, or ``a/b``; else NULL."""
    num = F.regexp_extract(c, _NUM_FRAC, 1)
    den = F.regexp_extract(c, _NUM_FRAC, 2)
    frac = F.when(num != "", F.try_divide(num.cast("double"), den.cast("double")))
    grouped = c.rlike(r"\A[+-]?\d{1,3}(,\d{3})+(\.\d+)?\z")  # a comma only as a thousands separator
    plain = F.when(grouped, F.replace(c, F.lit(","), F.lit(""))).otherwise(c)
    decimal = plain.rlike(r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z")
    return F.coalesce(frac, F.when(decimal, plain.try_cast("double")))


def math_equal(pred: Column | str, gold: Column | str, rel_tol: float = 1e-6) -> Column:
    """True when two answers are equal as numbers (within tolerance) or as strings.

    NULL when the gold answer is empty (unparseable), so callers can apply the
    reference's "unparseable gold" rule.
    """

    def equal(p: Column, g: Column) -> Column:
        pn, gn = to_number(p), to_number(g)
        numeric = F.abs(pn - gn) <= F.lit(rel_tol) * F.greatest(F.lit(1.0), F.abs(gn))
        eq = F.when(pn.isNotNull() & gn.isNotNull(), numeric).otherwise(p == g)
        return F.when(g == "", F.lit(None).cast("boolean")).otherwise(eq)

    # One array element holds both answers, so the texts are searched once and not at every use.
    both = F.array(F.struct(normalize_math(answer_text(pred)).alias("p"), normalize_math(answer_text(gold)).alias("g")))
    return F.get(F.transform(both, lambda x: equal(x["p"], x["g"])), 0)
