"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Each rule compares one text statistic with a cutoff from a fixed grid. On
labelled holdout documents of each stratum (language), a cutoff is admissible if
an exact binomial test shows, at a level corrected for every test made
(Bonferroni over strata, rules and cutoffs), that it rejects fewer than its share
of the good documents: with ``k`` of ``n`` good documents rejected,
``P(Bin(n, share) <= k) <= level``. Of the admissible cutoffs the one with the
largest surplus of rejected bad over rejected good documents is used (ties: the
laxest); a rule without one is off in that stratum. The shares of all rules add
up to ``RISK``, so a stratum loses at most that part of its good documents, with
probability ``1 - MISTAKE`` for all strata together. That needs thousands of good
documents in a stratum; ``op5_quality_rules`` does it, as its SQL does.

:func:`choose_by_sequence` (the pipeline's) spends the same ``RISK`` on the documents
that any rule rejects. In each stratum the cutoffs stand in one sequence from lax to
strict, in rounds over the rules, and each step adds one cutoff to those before, so
what is rejected only grows. The same exact test is made step by step at
``MISTAKE / strata`` and ends at the first failure, which needs no correction for
the steps. The sequence leaves out cutoffs that reject no more bad documents than the
rule's next laxer one; it looks at bad documents only, so the test stays exact.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from .common import SPACE, SPACE_CHARS, query, read, saved

RISK = 0.01
MISTAKE = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule -> cutoffs, rising; a document is rejected if its value is above the cutoff.
GRID: dict[str, tuple[float, ...]] = {
    "symbols": (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5),
    "dup_lines": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "long_words": (8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 30.0, 50.0),
    "short_words": (0.2, 0.22, 0.25, 0.28, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8),
}
_VALUE = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "n_words"),
    "short_words": ("n_words", "word_chars"),
}
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics of the whole text and ``base_failed``.

    A null text has no words and no lines with a word. Columns of these names
    are replaced. Windows of three words are compared by 64-bit hashes inside
    one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda l: F.btrim(l, F.lit(SPACE_CHARS)) != "")
    plain = [c for c in docs.columns if c not in METRICS]
    at = F.col("_words")
    d = docs.select(
        *plain,
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
    ).withColumn(
        "_windows",
        F.when(
            F.size(at) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(at) - 3), lambda i: F.xxhash64(at[i], at[i + 1], at[i + 2])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.select(
        *plain,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    s = F.col("_sorted")
    again = F.filter(
        s, lambda x, i: F.coalesce((x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]), x["h"] == F.get(s, i + 1)["h"], x["h"] == F.get(s, i - 1)["h"], F.lit(False))
    )
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
    )["n"]
    d = d.withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("_sorted")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return d.withColumn("base_failed", failed)


def _value(rule: str) -> Column:
    top, bottom = _VALUE[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _above(rule: str) -> Column:
    """How many of the rule's cutoffs the document is above."""
    value = _value(rule)
    return sum((F.when(value > F.lit(c), 1).otherwise(0) for c in GRID[rule]), F.lit(0))


def most_rejected(n: Column, share: float, level: Column) -> Column:
    """The largest k with P(Bin(n, share) <= k) <= level, -1 if there is none."""
    import math

    odds = math.log(share) - math.log1p(-share)
    steps = F.sequence(F.lit(0).cast("long"), F.ceil(n * F.lit(share)).cast("long"))

    def step(a: Column, i: Column) -> Column:
        cdf = a["cdf"] + F.exp(a["logp"])
        return F.struct(
            (a["logp"] + F.log((n - i).cast("double") / (i + 1).cast("double")) + F.lit(odds)).alias("logp"),
            cdf.alias("cdf"),
            F.when(cdf <= level, i).otherwise(a["k"]).alias("k"),
        )

    start = F.struct(
        (n.cast("double") * F.lit(math.log1p(-share))).alias("logp"),
        F.lit(0.0).alias("cdf"),
        F.lit(-1).cast("long").alias("k"),
    )
    return F.aggregate(steps, start, step)["k"]


def choose_cutoffs(
    metrics: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    id_col: str = "doc_id",
    risk: float = RISK,
    mistake: float = MISTAKE,
) -> DataFrame:
    """``stratum, rule, cutoff_index, cutoff``: the cutoffs in force (rules that are off are absent).

    ``labels`` has ``doc_id, quality`` (1 good, 0 bad; null is ignored; an id
    labelled twice counts twice). Documents that fail the base rules take no
    part. A null stratum is one of its own.
    """
    held = metrics.filter(~F.col("base_failed")).join(
        labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_label_id"), "quality"),
        F.col(id_col) == F.col("_label_id"),
    )
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), _above(r).alias("above")) for r in GRID])
    good = F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))
    counts = saved(
        held.select(F.col(stratum).alias("stratum"), "quality", F.explode(tests).alias("t"))
        .groupBy("stratum", "t.rule", "t.above")
        .agg(good.alias("good"), (F.count(F.lit(1)) - good).alias("bad"))
    )
    strata = counts.filter(F.col("rule") == next(iter(GRID))).groupBy("stratum").agg(F.sum("good").alias("n"))
    n_tests = max(1, strata.count()) * sum(map(len, GRID.values()))
    allowed = strata.select(
        F.col("stratum").alias("_s"), most_rejected(F.col("n"), risk / len(GRID), F.lit(mistake / n_tests)).alias("most")
    )
    per = (
        counts.filter(F.col("above") > 0)
        .withColumn("cutoff_index", F.explode(F.sequence(F.lit(0), F.col("above") - 1)))
        .groupBy("stratum", "rule", "cutoff_index")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .join(allowed, F.col("stratum").eqNullSafe(F.col("_s")))
        .filter((F.col("good") <= F.col("most")) & (F.col("bad") > F.col("good")))
    )
    best = F.max(F.struct((F.col("bad") - F.col("good")).alias("gain"), "cutoff_index"))["cutoff_index"]
    grid = F.create_map(*[x for r, cs in GRID.items() for x in (F.lit(r), F.array(*map(F.lit, cs)))])
    return per.groupBy("stratum", "rule").agg(best.alias("cutoff_index")).withColumn(
        "cutoff", F.element_at(F.element_at(grid, F.col("rule")), F.col("cutoff_index") + 1)
    )


def choose_by_sequence(
    metrics: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    id_col: str = "doc_id",
    risk: float = RISK,
    mistake: float = MISTAKE,
) -> DataFrame:
    """Columns and inputs of :func:`choose_cutoffs`; the bound holds for all rules of a stratum together.

    Of the steps that pass, the one with the largest surplus of rejected bad over
    rejected good documents is used (ties: the laxest); a stratum without a surplus,
    or with too few good documents for any step to pass, has no rule.
    """
    rules = list(GRID)
    held = metrics.filter(~F.col("base_failed")).join(
        labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_label_id"), "quality"),
        F.col(id_col) == F.col("_label_id"),
    )
    good, bad = (F.sum(F.when(F.col("quality") == q, F.col("n")).otherwise(0)) for q in (1, 0))
    counts = saved(
        held.select(F.col(stratum).alias("stratum"), "quality", F.array(*map(_above, rules)).alias("above"))
        .groupBy("stratum", "quality", "above")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    strata = saved(counts.groupBy("stratum").agg(good.alias("n_good")))
    allowed = strata.select(
        F.col("stratum").alias("_s"), most_rejected(F.col("n_good"), risk, F.lit(mistake / max(1, strata.count()))).alias("most")
    )
    # A rule's cutoff j rejects more bad documents than its next laxer one if some have exactly j + 1 cutoffs below them.
    rule_at = F.col("r")
    last = F.element_at(F.array(*[F.lit(len(GRID[r]) - 1) for r in rules]), rule_at + 1)
    steps = saved(
        counts.filter(F.col("quality") == 0)
        .select("stratum", F.posexplode("above").alias("r", "a"))
        .filter("a > 0")
        .select("stratum", "r", (F.col("a") - 1).alias("j"))
        .distinct()
        .withColumn("step", (last - F.col("j")) * len(rules) + rule_at)
    )
    sequence = steps.groupBy(F.col("stratum").alias("_s")).agg(F.collect_list(F.struct("r", "j", "step")).alias("_steps"))
    first = F.array_min(
        F.transform(F.filter("_steps", lambda x: F.get(F.col("above"), x["r"]) > x["j"]), lambda x: x["step"])
    )
    at = counts.join(sequence, F.col("stratum").eqNullSafe(F.col("_s"))).select("stratum", "quality", "n", first.alias("step"))
    upto = Window.partitionBy("stratum").orderBy("step")
    chosen = (
        at.filter(F.col("step").isNotNull())
        .groupBy("stratum", "step")
        .agg(good.alias("good"), bad.alias("bad"))
        .withColumns({"good": F.sum("good").over(upto), "bad": F.sum("bad").over(upto)})
        .join(allowed, F.col("stratum").eqNullSafe(F.col("_s")))
        .filter((F.col("good") <= F.col("most")) & (F.col("bad") > F.col("good")))
        .groupBy(F.col("stratum").alias("_s"))
        .agg((-F.max(F.struct((F.col("bad") - F.col("good")).alias("gain"), (-F.col("step")).alias("lax")))["lax"]).alias("_step"))
    )
    grid = F.create_map(*[x for r, cs in GRID.items() for x in (F.lit(r), F.array(*map(F.lit, cs)))])
    return (
        steps.join(chosen, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("step") <= F.col("_step")))
        .groupBy("stratum", F.element_at(F.array(*map(F.lit, rules)), rule_at + 1).alias("rule"))
        .agg(F.min("j").alias("cutoff_index"))
        .withColumn("cutoff", F.element_at(F.element_at(grid, F.col("rule")), F.col("cutoff_index") + 1))
    )


def apply_cutoffs(metrics: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``metrics`` with ``kept``; the cutoffs are a few rows for each stratum."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in GRID]
    )
    side, _ = broadcast_if_small(saved(wide), max_rows=100_000, max_bytes=16 << 20)
    joined = metrics.join(side, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for r in GRID:
        rejected = rejected | F.coalesce(_value(r) > F.col(f"_cut_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"_cut_{r}" for r in GRID])


def _grid_rows() -> str:
    return ", ".join(f"('{r}', {j}, CAST({c} AS DOUBLE))" for r, cs in GRID.items() for j, c in enumerate(cs))


OP5_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.lang, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
        coalesce(cov.n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'long_words', 'short_words']) AS rule,
        unnest([CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END,
                CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END,
                CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
                CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END,
                CASE WHEN word_chars > 0 THEN n_words / word_chars ELSE 0 END]) AS x FROM b),
g(rule, j, cutoff) AS (VALUES {_grid_rows()}),
held AS (SELECT v.*, labels.quality FROM v JOIN labels ON v.doc_id = labels.doc_id WHERE NOT base_failed AND quality IN (0, 1)),
strata AS (SELECT lang, count(*) FILTER (quality = 1) AS n FROM held WHERE rule = 'symbols' GROUP BY lang),
pmf(lang, n, i, logp, cdf) AS (
  SELECT lang, n, 0, n * ln(1 - {RISK / len(GRID)!r}::DOUBLE), exp(n * ln(1 - {RISK / len(GRID)!r}::DOUBLE)) FROM strata
  UNION ALL
  SELECT lang, n, i + 1, lp, cdf + exp(lp) FROM (
    SELECT *, logp + ln((n - i)::DOUBLE / (i + 1)) + ln({RISK / len(GRID)!r}::DOUBLE / (1 - {RISK / len(GRID)!r}::DOUBLE)) AS lp
    FROM pmf WHERE i < ceil(n * {RISK / len(GRID)!r}::DOUBLE))),
most AS (SELECT s.lang, coalesce(max(pmf.i) FILTER (cdf <= {MISTAKE}::DOUBLE / ((SELECT count(*) FROM strata) * {sum(map(len, GRID.values()))})), -1) AS k
         FROM strata s LEFT JOIN pmf ON s.lang IS NOT DISTINCT FROM pmf.lang GROUP BY s.lang),
rej AS (SELECT held.lang, g.rule, g.j, g.cutoff, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad
        FROM held JOIN g ON held.rule = g.rule AND held.x > g.cutoff GROUP BY ALL),
best AS (SELECT rej.lang, rule, arg_max(cutoff, (bad - good) * 100 + j) AS cutoff
         FROM rej JOIN most ON rej.lang IS NOT DISTINCT FROM most.lang
         WHERE good <= k AND bad > good GROUP BY rej.lang, rule),
bad AS (SELECT DISTINCT doc_id FROM v JOIN best ON v.lang IS NOT DISTINCT FROM best.lang AND v.rule = best.rule WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad WHERE doc_id IS NOT NULL) AS kept
FROM b
"""


@query("op5_quality_rules", OP5_SQL)
def op5(spark, sf_dir):
    """Statistics of every whole text of ``documents`` and the verdict of the fitted rules."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    metrics = saved(with_metrics(docs).drop("text"))
    cutoffs = choose_cutoffs(metrics, read(spark, sf_dir, "labels"))
    return apply_cutoffs(metrics, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
