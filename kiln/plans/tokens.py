"""Token-array preparation and training-log statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewards as R
from ..functions import tokens as T
from ..functions.text import split_words
from ..operators import groups as G
from ..operators.ranking import batch_ids
from ..operators.tokenize import pack_blocks, whitespace_vocabulary_ids
from ..sources.fixtures import rollouts, step_metrics
from ..sources.tables import read_table
from . import sqltext as S
from .registry import query

DEC = 6
PROMPT_TOKENS = 16
EOS_ID = 0

_IDS_CTE = r"""
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
      FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
v AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS token_id FROM (SELECT DISTINCT word FROM w)),
ids AS (SELECT d.doc_id, d.source, coalesce(t.input_ids, []) AS input_ids FROM documents d LEFT JOIN
         (SELECT doc_id, list(token_id ORDER BY pos) AS input_ids FROM w JOIN v USING (word) GROUP BY doc_id) t
         ON d.doc_id = t.doc_id)"""


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return whitespace_vocabulary_ids(d, "doc_id", "text", keep=["doc_id", "source"])[0]


@query("token_ids_vocab", ids=("T1", "X5"), sql=f"WITH {_IDS_CTE.strip()} SELECT doc_id, len(input_ids) AS n_tokens, input_ids FROM ids")
def q_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace tokens → ids from a corpus vocabulary ranked in byte order."""
    return token_ids(spark, sf_dir).select("doc_id", F.size("input_ids").alias("n_tokens"), "input_ids")


_MASK_SQL = f"""
WITH {_IDS_CTE.strip()},
b AS (SELECT doc_id, input_ids AS x, len(input_ids) AS n, least({PROMPT_TOKENS}, len(input_ids)) AS p,
             coalesce(list_max(list_transform(range(len(input_ids)), lambda i: CASE WHEN input_ids[i + 1] = {EOS_ID} THEN i ELSE -1 END)), -1) AS lastpos,
             coalesce(list_position(input_ids, {EOS_ID}), 0) AS firstpos
      FROM ids)
SELECT doc_id, n AS n_tokens, n - p AS mask_sum, p AS labels_ignored,
       least(greatest(lastpos, 0), n) AS labels2_ignored, least(n, 128) AS trunc_len,
       CASE WHEN p > 8 THEN x[p - 7:p] ELSE x[1:p] END AS kept_prompt,
       CAST(ceil(n / 64) * 64 AS INTEGER) AS padded_len, CAST(ceil(n / 64) * 64 AS INTEGER) - n AS pad_count,
       CASE WHEN firstpos = 0 THEN n ELSE firstpos END AS eos_mask_sum
FROM b
"""


@query("token_labels_masks", ids=("T2", "T3", "T4", "T5", "T6"), sql=_MASK_SQL)
def q_token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion mask, prompt-masked labels, evaluation-stage labels, truncation, padding, EOS mask."""
    t = token_ids(spark, sf_dir)
    n = F.size("input_ids")
    p = F.least(F.lit(PROMPT_TOKENS), n)
    t = t.withColumn("_n", n).withColumn("_p", p)
    mask = T.completion_mask(F.col("_p"), F.col("_n"))
    labels = T.mask_labels_before("input_ids", F.col("_p"))
    labels2 = T.mask_labels_before("input_ids", T.last_position_of("input_ids", EOS_ID))
    padded_len = T.round_up(F.col("_n"), 64)
    padded = T.pad_to("input_ids", padded_len, 0)
    padded_labels = T.pad_to(labels, padded_len, T.IGNORE_INDEX)

    def n_ignored(c):
        return F.size(F.filter(c, lambda x: x == T.IGNORE_INDEX))

    return t.select(
        "doc_id",
        F.col("_n").alias("n_tokens"),
        F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("mask_sum"),
        n_ignored(labels).alias("labels_ignored"),
        n_ignored(labels2).alias("labels2_ignored"),
        F.size(T.truncate("input_ids", 128)).alias("trunc_len"),
        T.keep_last(F.slice("input_ids", 1, F.col("_p")), 8).alias("kept_prompt"),
        F.size(padded).alias("padded_len"),
        (n_ignored(padded_labels) - n_ignored(labels)).alias("pad_count"),
        F.aggregate(T.eos_mask("input_ids", EOS_ID), F.lit(0), lambda a, x: a + x).alias("eos_mask_sum"),
    )


_BATCHED_SQL = f"""
WITH {_IDS_CTE.strip()},
b AS (SELECT doc_id, input_ids AS x, len(input_ids) AS n, least({PROMPT_TOKENS}, len(input_ids)) AS p,
             (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM ids),
m AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch) / 16) * 16 AS INTEGER) AS len FROM b),
j AS (SELECT doc_id, batch, len AS padded_len,
  list_concat(x, list_transform(range(len - n), lambda i: 0)) AS ids,
  list_concat(list_transform(range(p), lambda i: -100), x[p + 1:], list_transform(range(len - n), lambda i: -100)) AS labels,
  list_concat(list_transform(range(p), lambda i: 0), list_transform(range(n - p), lambda i: 1), list_transform(range(len - n), lambda i: 0)) AS cm,
  list_concat(list_transform(range(n), lambda i: 1), list_transform(range(len - n), lambda i: 0)) AS am,
  doc_id % 5 <> 0 OR n = 0 AS prompt_is_prefix,
  CASE WHEN list_contains(x, {EOS_ID}) THEN list_position(x, {EOS_ID}) ELSE 0 END AS eos_mask_sum FROM m)
SELECT doc_id, batch, padded_len, md5(array_to_string(ids, ' ')) AS ids_md5, md5(array_to_string(labels, ' ')) AS labels_md5,
       md5(array_to_string(cm, ' ')) AS completion_mask_md5, md5(array_to_string(am, ' ')) AS attention_mask_md5,
       prompt_is_prefix, CAST(eos_mask_sum AS INTEGER) AS eos_mask_sum FROM j
"""


@query("token_batches_padded", ids=("T2", "T3", "T4", "T6", "W4"), sql=_BATCHED_SQL)
def q_padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight rows padded to their longest: ids, labels, completion and attention mask.

    With them the flag of prompts that are not a prefix of their row (each fifth
    prompt is tokenized otherwise), and the EOS mask that drops truncated rows.
    """
    t = token_ids(spark, sf_dir).select("doc_id", "input_ids")
    t = batch_ids(t, ["doc_id"], 8).withColumn("p", F.least(F.lit(PROMPT_TOKENS), F.size("input_ids")))
    prompt = F.slice("input_ids", F.lit(1), F.col("p"))
    other = F.transform(prompt, lambda x: x + 1)
    prompt = F.when(F.col("doc_id") % 5 == 0, other).otherwise(prompt)
    t = t.select(
        "doc_id",
        "batch",
        "input_ids",
        T.mask_labels_before("input_ids", F.col("p")).alias("labels"),
        T.completion_mask(F.col("p"), F.size("input_ids")).alias("completion_mask"),
        T.prefix_matches(prompt, "input_ids").alias("prompt_is_prefix"),
        F.aggregate(T.eos_mask("input_ids", EOS_ID, zero_truncated=True), F.lit(0), lambda a, x: a + x).alias("eos_mask_sum"),
    )
    padded = T.padded_batch(t, "batch", "input_ids", "labels", ["completion_mask"], pad_id=0, multiple=16)

    def digest(c: str):
        return F.md5(F.array_join(F.col(c).cast("array<string>"), " "))

    return padded.select(
        "doc_id",
        "batch",
        "padded_len",
        digest("input_ids").alias("ids_md5"),
        digest("labels").alias("labels_md5"),
        digest("completion_mask").alias("completion_mask_md5"),
        digest("attention_mask").alias("attention_mask_md5"),
        "prompt_is_prefix",
        "eos_mask_sum",
    )


_ACC_SQL = f"""
WITH {_IDS_CTE.strip()},
b AS (SELECT input_ids AS x, len(input_ids) AS n, least({PROMPT_TOKENS}, len(input_ids)) AS p FROM ids),
z AS (SELECT unnest(range(0, n - 1)) AS i, x, p FROM b),
k AS (SELECT CASE WHEN i % 7 = 0 THEN -1 ELSE x[i + 2] END AS pred, x[i + 2] AS lab FROM z WHERE i + 1 >= p)
SELECT count(*) FILTER (WHERE pred = lab) AS correct, count(*) AS total,
       round(count(*) FILTER (WHERE pred = lab) / count(*), {DEC}) AS token_accuracy
FROM k
"""


@query("token_accuracy", ids=("A19",), sql=_ACC_SQL)
def q_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift-by-one token accuracy over completion labels against a next-token predictor stand-in."""
    t = token_ids(spark, sf_dir)
    n = F.size("input_ids")
    labels = T.mask_labels_before("input_ids", F.least(F.lit(PROMPT_TOKENS), n))
    pred = F.transform(
        "input_ids",
        lambda x, i: F.when((i % 7 == 0) | (i + 1 >= n), F.lit(-1)).otherwise(F.get(F.col("input_ids"), i + 1)),
    )
    correct, total = T.shifted_token_hits(pred, labels)
    s = t.select(correct.alias("c"), total.alias("t")).agg(F.sum("c").alias("correct"), F.sum("t").alias("total"))
    ratio = F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(F.col("correct") / F.col("total"))  # 0 / 0 as in the SQL
    return s.select("correct", "total", F.round(ratio, DEC).alias("token_accuracy"))


_PACK_SQL = f"""
WITH {_IDS_CTE.strip()},
o AS (SELECT source, doc_id, input_ids, sum(len(input_ids)) OVER (PARTITION BY source ORDER BY doc_id) - len(input_ids) AS off FROM ids),
t AS (SELECT source, off + unnest(range(len(input_ids))) AS g, unnest(input_ids) AS id FROM o)
SELECT source, CAST(g // 512 AS BIGINT) AS block, count(*) AS n_tokens, CAST(sum(id) AS BIGINT) AS id_sum, arg_min(id, g) AS first_id
FROM t GROUP BY source, g // 512
"""


@query("sequence_packing", ids=("T7",), sql=_PACK_SQL)
def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids per source laid end to end in doc order, cut into 512-token blocks."""
    b = pack_blocks(token_ids(spark, sf_dir), "source", "doc_id", "input_ids", 512)
    return b.select(
        "source",
        "block",
        F.size("input_ids").alias("n_tokens"),
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        F.get(F.col("input_ids"), 0).alias("first_id"),
    )


_WEIGHT_SQL = f"""
WITH {S.ROLLOUTS.strip()},
r AS (SELECT doc_id, prompt_id,
             {S.strip("regexp_extract_all(completion, '(?s)<reward>(.*?)</reward>', 1)[-1]")} AS body FROM rollouts),
v AS (SELECT doc_id, prompt_id, CASE WHEN json_valid(body) THEN try_cast(try_cast(body AS JSON) AS DOUBLE[]) END AS l FROM r),
k AS (SELECT doc_id, prompt_id, coalesce(l IS NOT NULL AND len(l) = 2 AND len(list_filter(l, lambda x: x IS NULL OR x < 0)) = 0, false) AS valid FROM v)
SELECT doc_id, round(CASE WHEN NOT valid THEN 0.01
                          ELSE greatest(0.0, 1.0 - prompt_id / ((SELECT max(prompt_id) + 1 FROM k) * 0.5)) END, {DEC})::DOUBLE AS weight
FROM k
"""


@query("stage2_weights", ids=("T8",), sql=_WEIGHT_SQL)
def q_stage2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample weight decaying over the first half of training; 0.01 when the self-grade is invalid."""
    r = rollouts(spark, sf_dir)
    total = rollouts(spark, sf_dir).agg(F.max("prompt_id") + 1).scalar()  # one value, computed within the query
    raw = R.rewarding_reward_raw(F.col("completion"), F.col("solution"))
    w = T.stage2_weight(F.col("prompt_id"), total, 0.5, raw["valid"])
    return r.select("doc_id", F.round(w, DEC).alias("weight"))


_METRIC_SQL = f"""
WITH {S.STEP_METRICS.strip()}
SELECT step, mode, metric, round(avg(value), {DEC}) AS mean_value,
       CASE WHEN mode = 'eval' THEN concat('eval_', metric) ELSE metric END AS log_name
FROM step_metrics GROUP BY step, mode, metric
"""


@query("step_metric_means", ids=("A10",), sql=_METRIC_SQL)
def q_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.metric_means(step_metrics(spark, sf_dir))
    return m.select("step", "mode", "metric", F.round("mean_value", DEC).alias("mean_value"), "log_name")


_CUM_SQL = f"""
WITH {S.ROLLOUTS.strip()},
t AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'eval' ELSE 'train' END AS mode, prompt_id // 10 AS step,
             len({S.words('completion')}) AS n_tokens FROM rollouts),
p AS (SELECT mode, step, sum(n_tokens) AS step_total FROM t GROUP BY mode, step)
SELECT mode, step, CAST(step_total AS BIGINT) AS step_total,
       CAST(sum(step_total) OVER (PARTITION BY mode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS num_tokens
FROM p
"""


@query("tokens_seen_cumulative", ids=("W6",), sql=_CUM_SQL)
def q_tokens_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per logged step, then the running total per mode."""
    r = rollouts(spark, sf_dir)
    t = r.select(
        F.when(F.col("doc_id") % 10 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("mode"),
        F.floor(F.col("prompt_id") / 10).cast("bigint").alias("step"),
        F.size(split_words("completion")).cast("bigint").alias("n_tokens"),
    )
    return G.cumulative_by_step(t, "n_tokens", "step", ("mode",), out="num_tokens")


_LEN_SQL = f"""
WITH {S.ROLLOUTS.strip()},
t AS (SELECT len({S.words('completion')})::DOUBLE AS l, instr(completion, '</answer>') > 0 AS term FROM rollouts)
SELECT round(avg(l), {DEC}) AS mean_length, min(l) AS min_length, max(l) AS max_length,
       round(coalesce(avg(l) FILTER (WHERE term), 0.0), {DEC}) AS mean_terminated_length,
       coalesce(min(l) FILTER (WHERE term), 0.0) AS min_terminated_length,
       coalesce(max(l) FILTER (WHERE term), 0.0) AS max_terminated_length,
       round(1.0 - (count(*) FILTER (WHERE term)) / count(*), {DEC}) AS clipped_ratio
FROM t
"""


@query("completion_length_stats", ids=("A9",), sql=_LEN_SQL)
def q_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion length mean/min/max, the same over terminated completions, clipped ratio."""
    r = rollouts(spark, sf_dir).select(
        F.size(split_words("completion")).alias("len"), F.col("completion").contains("</answer>").alias("term")
    )
    s = G.completion_length_stats(r, "len", "term")
    return s.select(*[F.round(c, DEC).alias(c) if c.startswith("mean") or c == "clipped_ratio" else F.col(c) for c in s.columns])
