"""Score rollouts and derive group statistics (Score + Group job families)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewards as R
from ..operators import groups as G
from ..sources.fixtures import rollouts
from . import sqltext as S
from .registry import query

DEC = 6  # output rounding of non-exact double arithmetic in checked results


def score_rollouts(r: DataFrame) -> DataFrame:
    """Reward columns computed once per row; later steps build on them."""
    return r.select(
        "doc_id",
        "prompt_id",
        "gen_idx",
        "completion",
        "solution",
        R.accuracy_reward("completion", "solution").alias("accuracy"),
        R.format_reward("completion").alias("format"),
    )


def score_and_advantage(r: DataFrame, scale_rewards: bool = True, materialize: bool = True) -> DataFrame:
    """Rewards are computed once per row; the narrow scored table (ids + rewards,
    no text) is written to the checkpoint folder so the group statistics and
    the per-row side of the join both read it instead of re-running the
    regexes over the completions."""
    scored = score_rollouts(r).select(
        "doc_id", "prompt_id", "gen_idx", "accuracy", "format",
        G.weighted_reward_sum(["accuracy", "format"]).alias("reward"),
    )
    if materialize:
        from ..session import checkpoint_dir

        checkpoint_dir(scored.sparkSession)
        scored = scored.checkpoint(eager=True)
    return G.group_advantages(scored, "reward", "prompt_id", scale_rewards=scale_rewards)


_ADV_SQL = f"""
WITH {S.ROLLOUTS.strip()},
s AS (SELECT doc_id, prompt_id, gen_idx, {S.accuracy('completion', 'solution')} AS accuracy,
             {S.fmt('completion')} AS format FROM rollouts),
t AS (SELECT *, coalesce(accuracy, 0.0) * 1.0 + coalesce(format, 0) * 1.0 AS reward FROM s),
g AS (SELECT prompt_id, avg(reward) AS m, stddev_samp(reward) AS sd FROM t GROUP BY prompt_id)
SELECT doc_id, t.prompt_id, gen_idx, accuracy, format, CAST(reward AS DOUBLE) AS reward,
       round(m, {DEC}) AS group_mean, round(sd, {DEC}) AS group_std, abs(sd) <= 1e-8 AS std_is_zero,
       round((reward - m) / (sd + 1e-4), {DEC}) AS advantage
FROM t JOIN g ON t.prompt_id = g.prompt_id
"""


@query("score_advantage", ids=("R1", "R2", "R5", "R6", "A5", "W1", "W2"), sql=_ADV_SQL)
def q_score_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts → accuracy + format → weighted sum → group-relative advantage."""
    a = score_and_advantage(rollouts(spark, sf_dir))
    return a.select(
        "doc_id",
        "prompt_id",
        "gen_idx",
        "accuracy",
        "format",
        "reward",
        F.round("group_mean", DEC).alias("group_mean"),
        F.round("group_std", DEC).alias("group_std"),
        "std_is_zero",
        F.round("advantage", DEC).alias("advantage"),
    )


# ---------------------------------------------------------------------------
# Tag / format rewards (R7–R10) and the self-grade rewards
# ---------------------------------------------------------------------------
_TAGS_SQL = f"""
WITH {S.ROLLOUTS.strip()}
SELECT doc_id,
       {S.count_formats('completion')} AS count_formats,
       {S.count_formats('completion')} + CASE WHEN regexp_matches(completion, '{S.FORMAT_RE}') THEN 0.5 ELSE 0.0 END::DOUBLE AS format_soft,
       {S.fmt_all('completion')} AS format_all,
       {S.count_formats('completion')} + CASE WHEN regexp_matches(completion, '{S.FORMAT_ALL_RE}') THEN 0.5 ELSE 0.0 END::DOUBLE AS format_all_soft,
       {S.tag_count('completion')} AS tag_count
FROM rollouts
"""


@query("reward_tags", ids=("R7", "R8", "R9", "R10"), sql=_TAGS_SQL)
def q_reward_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir)
    c = F.col("completion")
    return r.select(
        "doc_id",
        R.count_formats(c).alias("count_formats"),
        R.format_reward(c, soft=True).alias("format_soft"),
        R.format_all_reward(c).alias("format_all"),
        R.format_all_reward(c, soft=True).alias("format_all_soft"),
        R.tag_count_reward(c).alias("tag_count"),
    )


def _sql_reward_list(c: str) -> str:
    body = S.strip(f"regexp_extract_all({c}, '(?s)<reward>(.*?)</reward>', 1)[-1]")
    return f"CASE WHEN json_valid({body}) THEN try_cast(try_cast({body} AS JSON) AS DOUBLE[]) END"


_REWREW_SQL = f"""
WITH {S.ROLLOUTS.strip()},
a AS (SELECT doc_id, completion,
             coalesce({S.accuracy('completion', 'solution')}, 0.0) AS gt1,
             CAST({S.fmt('completion')} AS DOUBLE) AS gt2,
             {S.accuracy('completion', 'solution')} AS accuracy,
             {S.fmt_all('completion')} AS format_all,
             {_sql_reward_list('completion')} AS p
      FROM rollouts),
b AS (SELECT *, (p IS NOT NULL AND len(p) = 2 AND len(list_filter(p, lambda v: v IS NULL OR v < 0)) = 0) AS ok,
             greatest(gt1, p[1]) AS m1, greatest(gt2, p[2]) AS m2 FROM a)
SELECT doc_id,
       CASE WHEN NOT coalesce(ok, false) THEN 0.0 WHEN m1 = 0 OR m2 = 0 THEN 0.0
            ELSE round(1 - (abs(gt1 - p[1]) / m1 + abs(gt2 - p[2]) / m2) / 2, {DEC}) END::DOUBLE AS rewrew,
       CASE WHEN NOT coalesce(ok, false) THEN 0.0
            ELSE round(1 - ((CASE WHEN m1 = 0 THEN 0 ELSE abs(gt1 - p[1]) / m1 END)
                          + (CASE WHEN m2 = 0 THEN 0 ELSE abs(gt2 - p[2]) / m2 END)) / 2, {DEC}) END::DOUBLE AS rewrew_match,
       coalesce(ok, false) AS self_grade_valid,
       coalesce(len(p) = 2 AND p[1] = accuracy AND p[2] = format_all, false) AS rewrew_right
FROM b
"""


@query("reward_rewrew", ids=("R18", "R19", "R20", "R21", "R22"), sql=_REWREW_SQL)
def q_reward_rewrew(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir)
    c = F.col("completion")
    raw = R.rewarding_reward_raw(c, F.col("solution"))
    lst = R.parse_reward_list(c)
    return r.select(
        "doc_id",
        F.round(R.rewarding_reward(c, F.col("solution")), DEC).alias("rewrew"),
        F.round(R.rewarding_reward(c, F.col("solution"), zero_zero="match"), DEC).alias("rewrew_match"),
        raw["valid"].alias("self_grade_valid"),
        R.rewrew_right(lst, R.accuracy_reward(c, F.col("solution")), R.format_all_reward(c)).alias("rewrew_right"),
    )


_STEPS_SQL = r"""
SELECT doc_id,
       least(1.0, len(regexp_extract_all(text, '(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)')) / 3.0)::DOUBLE
         AS reasoning_steps
FROM documents
"""


@query("reward_reasoning_steps", ids=("R11",), sql=_STEPS_SQL)
def q_reasoning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table

    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", R.reasoning_steps_reward("text").alias("reasoning_steps"))


def _rep_sql(n: int, pen: float) -> str:
    w = S.words("text")
    grams = f"list_transform(range(0, len(w) - {n - 1}), lambda i: array_to_string(w[i + 1:i + {n}], ' '))"
    return f"""
SELECT doc_id,
       CASE WHEN text = '' THEN 0.0 WHEN len(w) < {n} THEN 0.0
            ELSE (1 - len(list_distinct({grams})) / (len(w) - {n - 1})) * ({pen}) END::DOUBLE AS repetition_penalty
FROM (SELECT doc_id, text, {w} AS w FROM documents)
"""


@query("reward_repetition", ids=("R13",), sql=_rep_sql(3, -1.0))
def q_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition penalty (3-grams, max −1) over every document's whole text."""
    from ..sources.tables import read_table

    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return R.with_repetition_penalty(d, "text", 3, -1.0).select("doc_id", "repetition_penalty")


_BRACED_SQL = r"(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*"


def _sql_answer_text(x: str) -> str:
    return (
        f"coalesce(regexp_extract_all({x}, '\\\\boxed\\{{({_BRACED_SQL})\\}}', 1)[-1], "
        f"CASE WHEN instr({x}, '<answer>') > 0 THEN {S.first_tag(x, '<answer>', '</answer>')} END, {x})"
    )


def _sql_norm_math(x: str) -> str:
    y = S.strip(x)
    y = f"regexp_replace({y}, '\\\\left|\\\\right|\\\\!|\\$', '', 'g')"
    y = f"regexp_replace({y}, '\\\\d?frac\\{{([^{{}}]*)\\}}\\{{([^{{}}]*)\\}}', '\\1/\\2', 'g')"
    return f"regexp_replace({y}, '\\s+', '', 'g')"


def _sql_to_number(x: str) -> str:
    pat = "^(-?[0-9]+(?:\\.[0-9]+)?)/(-?[0-9]+(?:\\.[0-9]+)?)$"
    num, den = f"regexp_extract({x}, '{pat}', 1)", f"regexp_extract({x}, '{pat}', 2)"
    frac = f"CASE WHEN {num} <> '' AND try_cast({den} AS DOUBLE) <> 0 THEN try_cast({num} AS DOUBLE) / try_cast({den} AS DOUBLE) END"
    return f"coalesce({frac}, try_cast(replace({x}, ',', '') AS DOUBLE))"


_COSINE_SQL = f"""
WITH {S.ROLLOUTS.strip()},
n AS (SELECT doc_id, prompt_id, completion,
             {_sql_norm_math(_sql_answer_text('completion'))} AS ps,
             {_sql_norm_math(_sql_answer_text('solution'))} AS gs FROM rollouts),
v AS (SELECT *, {_sql_to_number('ps')} AS pv, {_sql_to_number('gs')} AS gv FROM n),
c AS (SELECT *, CASE WHEN gs = '' THEN NULL
                     WHEN pv IS NOT NULL AND gv IS NOT NULL THEN abs(pv - gv) <= 1e-6 * greatest(1.0, abs(gv))
                     ELSE ps = gs END AS correct,
             length(completion) AS len FROM v),
w AS (SELECT *, min(len) OVER (PARTITION BY prompt_id) AS mn, max(len) OVER (PARTITION BY prompt_id) AS mx FROM c)
SELECT doc_id, correct,
       round(CASE WHEN correct IS NULL THEN 1.0
            WHEN correct THEN 0.5 + 0.5 * (1.0 - 0.5) * (1.0 + cos(len / 1000.0 * pi()))
            ELSE -0.5 + 0.5 * (-1.0 - -0.5) * (1.0 + cos(len / 1000.0 * pi())) END, {DEC})::DOUBLE AS cosine,
       round(CASE WHEN mx = mn THEN 0.0
            WHEN coalesce(correct, true) THEN 0.5 - (len - mn) / (mx - mn)
            ELSE least(0.0, 0.5 - (len - mn) / (mx - mn)) END, {DEC})::DOUBLE AS length_reward
FROM w
"""


@query("reward_cosine_length", ids=("R12", "R29", "W3"), sql=_COSINE_SQL)
def q_cosine_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine-scaled and group-relative length rewards with numeric answer matching."""
    r = rollouts(spark, sf_dir)
    c = r.select("doc_id", "prompt_id", "completion", R.math_correct("completion", "solution").alias("correct"))
    c = c.withColumn("cosine", R.cosine_scaled_reward("completion", F.col("correct")))
    lr = G.length_reward(c, "completion", "correct", scope="prompt_id")
    return lr.select(
        "doc_id", "correct", F.round("cosine", DEC).alias("cosine"), F.round("length_reward", DEC).alias("length_reward")
    )


_OVERLONG_SQL = f"""
SELECT doc_id, n_tokens,
       CASE WHEN n_tokens <= 1024 - 256 THEN 0.0
            WHEN n_tokens <= 1024 THEN (1024 - 256 - n_tokens) / 256.0
            ELSE -1.0 END::DOUBLE AS soft_overlong
FROM (SELECT doc_id, len({S.words('text')}) AS n_tokens FROM documents)
"""


@query("reward_soft_overlong", ids=("R17",), sql=_OVERLONG_SQL)
def q_soft_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft overlong penalty on whitespace-token counts (max 1024, cache 256)."""
    from ..functions.text import split_words
    from ..sources.tables import read_table

    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    n = F.size(split_words("text"))
    return d.select("doc_id", n.alias("n_tokens"), R.soft_overlong_punishment(n, 1024, 256).alias("soft_overlong"))


# ---------------------------------------------------------------------------
# Group statistics: pass rate (A3/P7/A4), group metrics (A6–A8), pass@1
# ---------------------------------------------------------------------------
_PASS_RATE_SQL = f"""
WITH {S.ROLLOUTS.strip()},
s AS (SELECT prompt_id, {S.accuracy('completion', 'solution')} AS acc FROM rollouts)
SELECT prompt_id, avg(acc) AS pass_rate, count(*) AS n_generations, count(acc) AS n_scored
FROM s GROUP BY prompt_id HAVING avg(acc) > 0.1 AND avg(acc) < 0.9
"""


@query("pass_rate_filter", ids=("A3", "P7"), sql=_PASS_RATE_SQL)
def q_pass_rate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir).select("prompt_id", R.accuracy_reward("completion", "solution").alias("acc"))
    return G.filter_pass_rate(G.pass_rates(r, "acc", "prompt_id"), 0.1, 0.9)


_COLLECT_SQL = f"""
WITH {S.ROLLOUTS.strip()},
s AS (SELECT prompt_id, gen_idx, completion, {S.accuracy('completion', 'solution')} AS acc FROM rollouts)
SELECT prompt_id, list(completion ORDER BY gen_idx) AS completions, list(acc ORDER BY gen_idx) AS accs
FROM s GROUP BY prompt_id
"""


@query("pass_rate_generations", ids=("A4",), sql=_COLLECT_SQL)
def q_collect_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir).select(
        "prompt_id", "gen_idx", "completion", R.accuracy_reward("completion", "solution").alias("acc")
    )
    return G.collect_generations(r, "prompt_id", "gen_idx", ["completion", "acc"])


_GROUP_METRICS_SQL = f"""
WITH {S.ROLLOUTS.strip()},
t AS (SELECT prompt_id, coalesce({S.accuracy('completion', 'solution')}, 0.0) + {S.fmt('completion')} AS reward FROM rollouts),
g AS (SELECT prompt_id, avg(reward) AS m, stddev_samp(reward) AS s FROM t GROUP BY prompt_id)
SELECT round(avg(m), {DEC}) AS reward, round(avg(s), {DEC}) AS reward_std,
       round(avg(CASE WHEN abs(s) <= 1e-8 THEN 1.0 ELSE 0.0 END), {DEC})::DOUBLE AS frac_reward_zero_std
FROM g
"""


@query("group_reward_metrics", ids=("A8",), sql=_GROUP_METRICS_SQL)
def q_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_rollouts(rollouts(spark, sf_dir))
    s = s.withColumn("reward", G.weighted_reward_sum(["accuracy", "format"]))
    m = G.group_reward_metrics(s, "reward", "prompt_id")
    return m.select(*[F.round(c, DEC).alias(c) for c in m.columns])


_SUMMARY_SQL = f"""
WITH {S.ROLLOUTS.strip()},
s AS (SELECT {S.accuracy('completion', 'solution')} AS accuracy, CAST({S.fmt('completion')} AS DOUBLE) AS format,
             {S.tag_count('completion')} AS tag_count FROM rollouts),
l AS (SELECT 'accuracy' AS reward_name, accuracy AS value FROM s UNION ALL
      SELECT 'format', format FROM s UNION ALL SELECT 'tag_count', tag_count FROM s)
SELECT reward_name, round(avg(value), {DEC}) AS mean, round(stddev_samp(value), {DEC}) AS std,
       min(value) AS min, max(value) AS max, count(value) AS n
FROM l GROUP BY reward_name
"""


@query("reward_summary", ids=("A6", "A7", "A18"), sql=_SUMMARY_SQL)
def q_reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollouts(spark, sf_dir).select(
        R.accuracy_reward("completion", "solution").alias("accuracy"),
        R.format_reward("completion").cast("double").alias("format"),
        R.tag_count_reward("completion").alias("tag_count"),
    )
    m = G.reward_summary(s, ["accuracy", "format", "tag_count"])
    return m.select("reward_name", F.round("mean", DEC).alias("mean"), F.round("std", DEC).alias("std"), "min", "max", "n")


_PASS1_SQL = f"""
WITH {S.ROLLOUTS.strip()},
p AS (SELECT prompt_id, avg(coalesce({S.accuracy('completion', 'solution')}, 0.0)) AS p FROM rollouts GROUP BY prompt_id)
SELECT round(avg(p), {DEC}) AS pass_at_1, count(*) AS n_problems FROM p
"""


@query("pass_at_1", ids=("A15",), sql=_PASS1_SQL)
def q_pass_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollouts(spark, sf_dir).select(
        "prompt_id", F.coalesce(R.accuracy_reward("completion", "solution"), F.lit(0.0)).alias("correct")
    )
    out = G.pass_at_1(s, "correct", "prompt_id")
    return out.select(F.round("pass_at_1", DEC).alias("pass_at_1"), "n_problems")


_FIRST_SQL = f"""
WITH {S.ROLLOUTS.strip()}
SELECT prompt_id, doc_id, gen_idx, solution FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY gen_idx, doc_id) AS rn FROM rollouts) WHERE rn = 1
"""


@query("distinct_prompts", ids=("A16",), sql=_FIRST_SQL)
def q_distinct_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir).select("prompt_id", "doc_id", "gen_idx", "solution")
    return G.first_per_group(r, "prompt_id", ["gen_idx", "doc_id"])


_MISSING_SQL = f"""
WITH {S.ROLLOUTS.strip()},
s AS (SELECT doc_id, {S.accuracy('completion', 'solution')} AS accuracy,
             {S.accuracy('completion', "concat('<answer>', cast(prompt_id % 3 AS string), '</answer>')")} AS accuracy_alt
      FROM rollouts)
SELECT doc_id FROM s WHERE accuracy IS NULL AND accuracy_alt IS NULL
"""


@query("rewards_all_missing", ids=("A21",), sql=_MISSING_SQL)
def q_all_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where every reward is missing (none here, since every gold parses)."""
    r = rollouts(spark, sf_dir)
    alt = F.concat(F.lit("<answer>"), (F.col("prompt_id") % 3).cast("string"), F.lit("</answer>"))
    s = r.select(
        "doc_id",
        R.accuracy_reward("completion", "solution").alias("accuracy"),
        R.accuracy_reward(F.col("completion"), alt).alias("accuracy_alt"),
    )
    return G.rows_with_all_rewards_missing(s, ["accuracy", "accuracy_alt"]).select("doc_id")


def character_segments(text):
    """Stand-in word segmenter hook: every character is a token."""
    return F.split(text, "")


_REP_SEG_SQL = """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents WHERE text <> ''),
g AS (SELECT doc_id, ch || ' ' || lead(ch) OVER w || ' ' || lead(ch, 2) OVER w AS g FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, count(g) AS total, count(DISTINCT g) AS kinds FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text = '' THEN 0.0 WHEN length(text) < 3 THEN 0.0 WHEN text IS NOT NULL THEN (1 - kinds / total) * (-1.0)
       END::DOUBLE AS repetition_penalty
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("reward_repetition_segmented", ids=("R14",), sql=_REP_SEG_SQL)
def q_repetition_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition penalty of every document through a segmenter hook (character tokens)."""
    from ..sources.tables import read_table

    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return R.with_repetition_penalty(d, "text", 3, -1.0, segmenter=character_segments).select("doc_id", "repetition_penalty")


_CHUNK_SQL = f"""
WITH {S.ROLLOUTS.strip()},
s AS (SELECT prompt_id // 5 AS group_id, doc_id, md5(completion) AS completion FROM rollouts),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS n FROM s)
SELECT group_id, CAST(CASE WHEN n > 8 THEN i // 8 ELSE 0 END AS BIGINT) AS chunk, list(completion ORDER BY doc_id) AS completions
FROM r GROUP BY 1, 2
"""


@query("generations_in_chunks", ids=("A4",), sql=_CHUNK_SQL)
def q_generation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five prompts' generations as one long group, cut into ordered runs of eight."""
    r = rollouts(spark, sf_dir).select(
        F.floor(F.col("prompt_id") / 5).cast("long").alias("group_id"), "doc_id", F.md5("completion").alias("completion")
    )
    return G.collect_generations(r, "group_id", "doc_id", ["completion"], chunk=8)


_BY_SQL = f"""
WITH {S.ROLLOUTS.strip()},
s AS (SELECT CASE WHEN gen_idx < 2 THEN 'a' ELSE 'b' END AS config, {S.accuracy('completion', 'solution')} AS accuracy,
             {S.tag_count('completion')} AS tag_count FROM rollouts),
l AS (SELECT config, 'accuracy' AS reward_name, accuracy AS value FROM s UNION ALL SELECT config, 'tag_count', tag_count FROM s)
SELECT config, reward_name, round(avg(value), {DEC}) AS mean, round(stddev_samp(value), {DEC}) AS std,
       min(value) AS min, max(value) AS max, count(value) AS n
FROM l GROUP BY config, reward_name
"""


@query("reward_summary_by_config", ids=("A18",), sql=_BY_SQL)
def q_reward_summary_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward statistics for each configuration (the first two generations of a prompt, and the others)."""
    s = rollouts(spark, sf_dir).select(
        F.when(F.col("gen_idx") < 2, "a").otherwise("b").alias("config"),
        R.accuracy_reward("completion", "solution").alias("accuracy"),
        R.tag_count_reward("completion").alias("tag_count"),
    )
    m = G.reward_summary(s, ["accuracy", "tag_count"], by=["config"])
    return m.select("config", "reward_name", F.round("mean", DEC).alias("mean"), F.round("std", DEC).alias("std"), "min", "max", "n")
