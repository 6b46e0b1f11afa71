"""Evaluation reports, checked joins, formatter variants and user hooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curation as CU
from ..functions import formatters as FM
from ..functions import hooks as H
from ..functions import report as RP
from ..operators import curate as OC
from ..operators.ranking import global_row_number
from ..sources.fixtures import qa_hash, rollouts
from ..sources.tables import read_table
from . import sqltext as S
from .curation import _lit, bool_qa, multiple_choice_raw, teacher_stats
from .registry import query

SEED = 42


def _sql_num(x: str) -> str:
    return f"coalesce(CAST(CAST({x} AS DOUBLE) AS VARCHAR), 'None')"


def _sql_bool(x: str) -> str:
    return f"CASE WHEN {x} THEN 'True' ELSE 'False' END"


_STRICT_RE = r"(?s)^<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>(\n|$)"

def report_sql(rollouts_cte: str, other: str | None = None) -> str:
    """The report and its summary over a ``rollouts`` view; ``other``: SQL of one more reward, shown as ``other_reward``."""
    line = f", sep, 'other_reward: reward=', {_sql_num('other')}" if other else ""
    perfect = " AND (other IS NULL OR other < 0 OR other = 1.0)" if other else ""
    return f"""
WITH {rollouts_cte.strip()},
a AS (SELECT doc_id, completion, {other or 'NULL'} AS other, {S.answer('solution')} AS gold, {S.answer('completion')} AS pred FROM rollouts),
b AS (SELECT *, CASE WHEN length(gold) = 0 OR length(pred) = 0 THEN NULL WHEN pred = gold THEN 1.0 ELSE 0.0 END AS acc,
             instr(completion, '<think>') > 0 AND instr(completion, '</think>') > 0 AS ht,
             instr(completion, '<answer>') > 0 AND instr(completion, '</answer>') > 0 AS ha,
             regexp_matches(completion, '{_STRICT_RE}') AS valid,
             ((length(completion) - length(replace(completion, '<think>' || chr(10), ''))) // 8) AS c1,
             ((length(completion) - length(replace(completion, chr(10) || '</think>' || chr(10), ''))) // 10) AS c2,
             ((length(completion) - length(replace(completion, chr(10) || '<answer>' || chr(10), ''))) // 10) AS c3,
             ((length(completion) - length(replace(completion, chr(10) || '</answer>', ''))) // 10) AS c4,
             CAST(('0x' || substring(md5(concat('{SEED}:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS si
      FROM a),
c AS (SELECT *, CASE WHEN valid THEN 1.0 ELSE 0.0 END AS fmt,
             (CASE WHEN c1 = 1 THEN 0.25 ELSE 0.0 END + CASE WHEN c2 = 1 THEN 0.25 ELSE 0.0 END
              + CASE WHEN c3 = 1 THEN 0.25 ELSE 0.0 END + CASE WHEN c4 = 1 THEN 0.25 ELSE 0.0 END) AS tag,
             [chr(10), chr(10) || '---' || chr(10), chr(10) || chr(10), ' | ', chr(10) || '• '][si + 1] AS sep FROM b),
d AS (SELECT doc_id, acc, fmt, tag, other, c1, c2, c3, c4,
             concat('accuracy evaluation:' || chr(10) || '  - Model output: ', CASE WHEN length(gold) > 0 AND length(pred) > 0 THEN pred ELSE 'None' END,
                    chr(10) || '  - Expected: ', CASE WHEN length(gold) > 0 THEN gold ELSE 'None' END,
                    chr(10) || '  - Match status: ', CASE WHEN acc IS NULL THEN 'evaluation_failed' WHEN acc = 1.0 THEN 'match' ELSE 'mismatch' END,
                    chr(10) || '  → reward=', {_sql_num('acc')},
                    sep, 'format: think=', {_sql_bool('ht')}, ', answer=', {_sql_bool('ha')}, ', valid=', {_sql_bool('valid')},
                    ' → reward=', {_sql_num('fmt')},
                    sep, 'tag_count: <think>=', CAST(c1 AS VARCHAR), ', </think>=', CAST(c2 AS VARCHAR), ', <answer>=', CAST(c3 AS VARCHAR),
                    ', </answer>=', CAST(c4 AS VARCHAR), ' → reward=', {_sql_num('tag')}{line}) AS body FROM c)
SELECT doc_id, md5(CASE WHEN (acc IS NULL OR acc = 1.0) AND fmt = 1.0 AND tag = 1.0{perfect} THEN concat(body, chr(10) || 'All rewards are 1.0') ELSE body END) AS report_md5,
       concat('accuracy = ', {_sql_num('acc')}, ', format = ', {_sql_num('fmt')}, ', tag_count = ', {_sql_num('tag')}) AS summary,
       concat(CASE WHEN tag = 1.0 THEN 'tag_count: all tags present' ELSE concat('tag_count: missing tags ', concat_ws(', ',
         CASE WHEN c1 <> 1 THEN '<think>' END, CASE WHEN c2 <> 1 THEN '</think>' END, CASE WHEN c3 <> 1 THEN '<answer>' END,
         CASE WHEN c4 <> 1 THEN '</answer>' END)) END, ' → reward=', {_sql_num('tag')}) AS missing_tags
FROM d
"""


@query("evaluation_report", ids=("R25", "R26", "R27", "R28"), sql=report_sql(S.ROLLOUTS))
def q_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-rollout report text (accuracy / strict format / strict tag counts, seeded separator)."""
    r = rollouts(spark, sf_dir)
    rep = RP.evaluation_report(F.col("completion"), F.col("solution"), F.col("doc_id"), seed=SEED)
    return r.select(
        "doc_id",
        F.md5(rep).alias("report_md5"),
        RP.evaluation_summary(F.col("completion"), F.col("solution")).alias("summary"),
        RP.missing_tags_report("completion").alias("missing_tags"),
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qa_hash(spark, sf_dir)
    r = global_row_number(q, ["index"], out="_rn")
    return r.select(
        F.concat(F.lit("train_"), F.lpad((F.col("_rn") - 1).cast("string"), 6, "0")).alias("custom_id"),
        F.col("index"),
        F.col("question").alias("request_question"),
    )


_MERGE_SQL = f"""
WITH {S.QA_HASH.strip()}, {S.ROLLOUTS.strip()},
req AS (SELECT concat('train_', lpad(CAST(row_number() OVER (ORDER BY index) - 1 AS VARCHAR), 6, '0')) AS custom_id,
               index, question AS request_question FROM qa_hash),
outp AS (SELECT custom_id, index FROM req),
raw AS (SELECT index, question FROM qa_hash)
SELECT req.custom_id, raw.question, md5(r.completion) AS response_md5, req.request_question = raw.question AS fields_agree
FROM req JOIN raw ON req.index = raw.index JOIN rollouts r ON r.doc_id = req.index
"""


@query("teacher_request_merge", ids=("J2",), sql=_MERGE_SQL)
def q_request_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher output ⋈ requests on ``custom_id`` ⋈ raw rows; the question text must agree."""
    req = _requests(spark, sf_dir)
    outputs = req.select("custom_id", "index").join(
        rollouts(spark, sf_dir).select(F.col("doc_id").alias("index"), F.col("completion").alias("response")), "index"
    ).drop("index")
    raw = qa_hash(spark, sf_dir).select("index", "question")
    j = OC.join_checked(req.join(outputs, "custom_id"), raw, "index", "request_question", "question")
    return j.select("custom_id", "question", F.md5("response").alias("response_md5"), "fields_agree")


_POS_SQL = """
WITH t AS (SELECT doc_id AS qid, row_number() OVER (ORDER BY doc_id) AS pos FROM labels),
r AS (SELECT doc_id AS qid, row_number() OVER (ORDER BY doc_id) AS pos, quality FROM labels)
SELECT t.qid, r.quality, t.pos = r.pos AS fields_agree FROM t JOIN r ON t.qid = r.qid
"""


@query("position_checked_join", ids=("J3",), sql=_POS_SQL)
def q_position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher rows and raw rows joined on their id; their file positions are only checked."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    t = global_row_number(lab.select(F.col("doc_id").alias("qid")), ["qid"], out="pos")
    r = global_row_number(lab.select(F.col("doc_id").alias("qid"), "quality"), ["qid"], out="raw_pos")
    j = OC.join_checked(t, r, "qid", "pos", "raw_pos")
    return j.select("qid", "quality", "fields_agree")


_LANG_SQL = """
SELECT lang, count(*) AS n, (SELECT count(DISTINCT lang) FROM documents) = 1 AS single_language FROM documents GROUP BY lang
"""


@query("language_check", ids=("A22",), sql=_LANG_SQL)
def q_language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per language and whether one language covers all rows (the enforce-same-language check)."""
    d = read_table(spark, sf_dir, "documents", ["lang"])
    single = OC.single_value(d, "lang")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("single_language", F.lit(single))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bool_qa(spark, sf_dir).withColumnRenamed("model_answer", "response").withColumn("stat_rewrew_right", F.lit(True))
    m = multiple_choice_raw(spark, sf_dir).select(
        "doc_id",
        CU.question_with_options("Problem", "options").alias("question"),
        CU.gold_choice("correct").alias("answer"),
        CU.strip_one_quote("Rationale").alias("rationale"),
        F.col("Problem").alias("response"),
        F.lit(False).alias("stat_rewrew_right"),
    )
    t = teacher_stats(spark, sf_dir).select(
        F.col("request_index").alias("doc_id"), "question", "answer", "response", "stat_rewrew_right"
    )
    out = []
    specs = [
        ("gsm8k_teacher_sft", FM.formatter_for("gsm8k_x", "sft"), t, "completion"),
        ("strategyqa_rft", FM.formatter_for("strategyqa", "rft"), b, "sft_completion"),
        ("strategyqa_teacher_sft", FM.formatter_for("strategyqa_x", "sft"), b, "completion"),
        ("strategyqa_teacher_rft", FM.formatter_for("strategyqa_x", "rft"), b, "sft_completion"),
        ("mathqa_rft", FM.formatter_for("mathqa", "rft"), m, "sft_completion"),
        ("mathqa_teacher_sft", FM.formatter_for("mathqa_x", "sft"), m, "completion"),
        ("mathqa_teacher_rft", FM.formatter_for("mathqa_x", "rft"), m, "sft_completion"),
    ]
    for name, fn, df, ccol in specs:
        recs = fn(df, keep=["doc_id"])
        out.append(
            recs.select(
                F.lit(name).alias("variant"),
                "doc_id",
                F.col("prompt")[0]["content"].alias("system"),
                F.md5(F.col("prompt")[1]["content"]).alias("user_md5"),
                F.md5(F.col(ccol)[0]["content"]).alias("completion_md5"),
                (F.col("rewrew_valid") if "rewrew_valid" in recs.columns else F.lit(None).cast("boolean")).alias("rewrew_valid"),
            )
        )
    u = out[0]
    for o in out[1:]:
        u = u.unionByName(o)
    return u


def _variants_sql() -> str:
    tagged = lambda r, a: f"concat('<think>', {r}, '</think>' || chr(10) || '<answer>', {a}, '</answer>')"
    from .curation import _sql_teacher

    teacher = _sql_teacher() + ",\nte AS (SELECT t.request_index AS doc_id, qa.question, qa.answer, t.r AS response, "
    teacher += "coalesce(len(lst) = 2 AND lst[1] = stat_accuracy_reward AND lst[2] = stat_format_all_reward, false) AS ok "
    teacher += "FROM t JOIN qa_hash qa ON t.request_index = qa.index),"
    bq = """
bq AS (SELECT l.doc_id, concat('Is this passage high quality? ', d.text) AS question, l.quality = 1 AS answer,
              string_split(d.text, chr(10)) AS facts FROM labels l JOIN documents d ON l.doc_id = d.doc_id),"""
    mc = f"""
mc AS (SELECT doc_id, concat(text, chr(10) || 'Options: ',
              concat_ws(' , ', {", ".join(f"concat('{ch} ) ', cast((n_chars + {i}) % 97 AS varchar))" for i, ch in enumerate("abcde"))})) AS question,
              lower({S.strip("concat(' ', substring('ABCDE', CAST(doc_id % 5 + 1 AS INTEGER), 1), ' ')")}) AS answer,
              regexp_replace(regexp_replace(concat('\"', text, '\"'), '^\"', ''), '\"$', '') AS rationale,
              text AS response FROM documents)"""
    sp = FM.SYSTEM_PROMPTS
    facts_ans = tagged("array_to_string(facts, ' ')", "CASE WHEN answer THEN 'True' ELSE 'False' END")
    rat_ans = tagged("rationale", "answer")
    bool_resp = "CASE WHEN l2.toxic = 1 THEN ' TRUE ' WHEN l2.quality = 1 THEN 'false' ELSE 'maybe' END"
    rows = [
        f"SELECT 'gsm8k_teacher_sft' AS variant, doc_id, {_lit(sp[('gsm8k', 'taer')])} AS system, md5(question) AS user_md5, md5(response) AS completion_md5, CAST(NULL AS BOOLEAN) AS rewrew_valid FROM te",
        f"SELECT 'strategyqa_rft', doc_id, {_lit(sp[('strategyqa', 'taer')])}, md5(question), md5({facts_ans}), CAST(NULL AS BOOLEAN) FROM bq",
        f"SELECT 'strategyqa_teacher_sft', bq.doc_id, {_lit(sp[('strategyqa', 'taer')])}, md5(question), md5({bool_resp}), CAST(NULL AS BOOLEAN) FROM bq JOIN labels l2 ON bq.doc_id = l2.doc_id",
        f"SELECT 'strategyqa_teacher_rft', doc_id, {_lit(sp[('strategyqa', 'taer')])}, md5(question), md5({facts_ans}), true FROM bq",
        f"SELECT 'mathqa_rft', doc_id, {_lit(sp[('mathqa', 'taer')])}, md5(question), md5({rat_ans}), CAST(NULL AS BOOLEAN) FROM mc",
        f"SELECT 'mathqa_teacher_sft', doc_id, {_lit(sp[('mathqa', 'taer')])}, md5(question), md5(response), CAST(NULL AS BOOLEAN) FROM mc",
        f"SELECT 'mathqa_teacher_rft', doc_id, {_lit(sp[('mathqa', 'taer')])}, md5(question), md5({rat_ans}), false FROM mc",
    ]
    return teacher + bq + mc + "\n" + "\nUNION ALL\n".join(rows)


@query("formatter_variants", ids=("F3", "F6", "F7", "F8", "F10", "F11", "F12", "P5"), sql=_variants_sql())
def q_formatter_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every remaining formatter, picked through the name router, over the stand-in QA tables."""
    return _variants(spark, sf_dir)


_BACKUP_SQL = f"""
WITH {S.QA_HASH.strip()}
SELECT index, question AS prompt, {_lit(FM.SYSTEM_PROMPTS[('gsm8k', 'taer')])} AS rendered_system, question AS rendered_user
FROM qa_hash
"""


@query("prompt_backup_restore", ids=("P8", "C11"), sql=_BACKUP_SQL)
def q_prompt_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the original prompt, overwrite it with chat messages for scoring, restore it afterwards."""
    q = qa_hash(spark, sf_dir).select("index", F.col("question").alias("prompt"))
    b = OC.backup_column(q, "prompt")
    b = b.withColumn("prompt", CU.prompt_messages(F.col("prompt"), FM.SYSTEM_PROMPTS[("gsm8k", "taer")]))
    used = b.select(
        "index",
        "prompt",
        "prompt" + OC.BACKUP_SUFFIX,
        F.col("prompt")[0]["content"].alias("rendered_system"),
        F.col("prompt")[1]["content"].alias("rendered_user"),
    )
    return OC.keep_fields(OC.restore_column(used, "prompt"), ["index", "prompt", "rendered_system", "rendered_user"])


def _word_count_reward(c: pd.Series, s: pd.Series) -> pd.Series:
    return c.str.split().str.len() / 100.0


_HOOKS_SQL = f"""
WITH {S.ROLLOUTS.strip()}
SELECT doc_id, CAST({S.accuracy('completion', 'solution')} AS DOUBLE) AS accuracy, len({S.words('completion')}) / 100.0::DOUBLE AS word_count,
       CAST((length(completion) - length(replace(completion, '<answer>', ''))) / 8 AS DOUBLE) AS model_score,
       concat('### ', solution) AS formatted
FROM rollouts
"""


@query("user_reward_hooks", ids=("X1", "X2", "X3", "R24"), sql=_HOOKS_SQL)
def q_user_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user reward by name (pandas UDF), a formatting function and a batched reward model."""
    H.register_reward("word_count", H.python_reward(_word_count_reward))
    acc, wc = H.get_rewards(["accuracy", "word_count"])
    model = H.reward_model(lambda texts: texts.str.count("<answer>").astype("float64"))
    r = rollouts(spark, sf_dir)
    fmt = H.formatting_func(lambda c: F.concat(F.lit("### "), c))
    r = fmt(r, "solution", "formatted")
    return r.select(
        "doc_id",
        acc("completion", "solution").alias("accuracy"),
        wc("completion", "solution").alias("word_count"),
        model(F.col("completion")).alias("model_score"),
        "formatted",
    )


def _echo_generator(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two generations for each prompt: its words backwards, and its words in capitals."""
    words = pdf["prompt"].str.split()
    back = pd.DataFrame({"prompt": pdf["prompt"], "gen_no": 0, "generation": words.str[::-1].str.join(" ")})
    loud = pd.DataFrame({"prompt": pdf["prompt"], "gen_no": 1, "generation": pdf["prompt"].str.upper()})
    return pd.concat([back, loud])


_GENERATE_SQL = f"""
WITH {S.ROLLOUTS.strip()},
p AS (SELECT doc_id, concat('problem ', prompt_id, ' ', solution) AS prompt FROM rollouts)
SELECT doc_id, prompt, CAST(i AS INTEGER) AS gen_no,
       CASE i WHEN 0 THEN array_to_string(list_reverse(string_split(prompt, ' ')), ' ') ELSE upper(prompt) END AS generation
FROM p, (VALUES (0), (1)) g(i)
"""


@query("generate_once_per_prompt", ids=("X4",), sql=_GENERATE_SQL)
def q_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations for each distinct prompt (mapInPandas), joined back to every row."""
    r = rollouts(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("problem "), F.col("prompt_id").cast("string"), F.lit(" "), F.col("solution")).alias("prompt")
    )
    return H.generate_once_per_prompt(r, "prompt", _echo_generator, "prompt string, gen_no int, generation string")

