"""Curation jobs: teacher output → checked, formatted training records (Curate family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curation as CU
from ..functions import formatters as FM
from ..functions import rewards as R
from ..functions.code import truncate_at
from ..operators import curate as OC
from ..sources.fixtures import qa_hash, rollouts
from ..sources.tables import read_table
from . import sqltext as S
from .registry import query


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_hash_answer(a: str) -> str:
    return (
        f"CASE WHEN len(string_split({a}, '####')) = 2 THEN concat('<think>', {S.strip(f'split_part({a}, ' + chr(39) + '####' + chr(39) + ', 1)')}, "
        f"'</think>' || chr(10) || '<answer>', {S.strip(f'split_part({a}, ' + chr(39) + '####' + chr(39) + ', 2)')}, '</answer>') ELSE {a} END"
    )


def _flat(df: DataFrame, key: str, completion_col: str) -> DataFrame:
    return df.select(
        key,
        F.size("prompt").alias("n_prompt"),
        F.col("prompt")[0]["role"].alias("first_role"),
        F.col("prompt")[0]["content"].alias("system"),
        F.col("prompt")[1]["content"].alias("user"),
        F.col(completion_col)[0]["role"].alias("completion_role"),
        F.col(completion_col)[0]["content"].alias("completion"),
    )


_GSM_SFT_SQL = f"""
WITH {S.QA_HASH.strip()}
SELECT index, 2 AS n_prompt, 'system' AS first_role, {_lit(FM.SYSTEM_PROMPTS[('gsm8k', 'ta')])} AS system,
       question AS user, 'assistant' AS completion_role, {_sql_hash_answer('answer')} AS completion
FROM qa_hash
"""


@query("gsm8k_sft_records", ids=("F1", "C3", "C11", "C14", "SRC1"), sql=_GSM_SFT_SQL)
def q_gsm8k_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reasoning #### result`` QA → system+user prompt and a tagged assistant completion."""
    recs = FM.gsm8k_sft(qa_hash(spark, sf_dir), keep=["index"])
    return _flat(recs, "index", "completion")


_GSM_RFT_SQL = f"""
WITH {S.QA_HASH.strip()}
SELECT index, 2 AS n_prompt, 'system' AS first_role, {_lit(FM.SYSTEM_PROMPTS[('gsm8k', 'taer')])} AS system,
       question AS user, 'assistant' AS completion_role, {_sql_hash_answer('answer')} AS completion,
       {_sql_hash_answer('answer')} AS solution
FROM qa_hash
"""


@query("gsm8k_rft_records", ids=("F2", "F13"), sql=_GSM_RFT_SQL)
def q_gsm8k_rft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFT records via the name router (``gsm8k`` → plain RFT formatter)."""
    fmt = FM.formatter_for("openai/gsm8k", "rft")
    recs = fmt(qa_hash(spark, sf_dir), keep=["index"])
    return _flat(recs, "index", "sft_completion").join(recs.select("index", "solution"), "index")


def teacher_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in teacher output: request text with the question, and a tagged response."""
    r = rollouts(spark, sf_dir)
    q = qa_hash(spark, sf_dir)
    j = r.join(q, r["doc_id"] == q["index"], "inner")
    response = F.when(
        F.col("doc_id") % 2 == 0,
        F.replace(F.replace(F.col("completion"), F.lit("<think>"), F.lit("<thinking>")), F.lit("</think>"), F.lit("</thinking>")),
    ).otherwise(F.col("completion"))
    return j.select(
        F.col("doc_id").alias("index"),
        F.concat(F.lit("Solve the problem below.\nYour Question:\n\n"), F.col("question")).alias("request_text"),
        response.alias("response"),
    )


def _sql_teacher() -> str:
    resp = "replace(replace(replace(replace(response, '<thinking>', '<think>'), '</thinking>', '</think>'), '<answering>', '<answer>'), '</answering>', '</answer>')"
    body = S.strip("regexp_extract_all(r, '(?s)<reward>(.*?)</reward>', 1)[-1]")
    lst = f"CASE WHEN json_valid({body}) THEN try_cast(try_cast({body} AS JSON) AS DOUBLE[]) END"
    return f"""
WITH {S.ROLLOUTS.strip()}, {S.QA_HASH.strip()},
raw AS (SELECT doc_id AS index, concat('Solve the problem below.' || chr(10) || 'Your Question:' || chr(10) || chr(10), question) AS request_text,
               CASE WHEN doc_id % 2 = 0 THEN replace(replace(completion, '<think>', '<thinking>'), '</think>', '</thinking>')
                    ELSE completion END AS response
        FROM rollouts JOIN qa_hash ON rollouts.doc_id = qa_hash.index),
q AS (SELECT index AS request_index, split_part(request_text, 'Your Question:' || chr(10) || chr(10), 2) AS question,
             {resp} AS r FROM raw),
g AS (SELECT question, arg_max(answer, index) AS answer FROM qa_hash GROUP BY question),
j AS (SELECT q.*, {S.strip("split_part(g.answer, '####', 2)")} AS pure_answer FROM q JOIN g ON q.question = g.question),
s AS (SELECT request_index, pure_answer, r,
             CASE WHEN length(pure_answer) = 0 THEN NULL WHEN {S.answer('r')} = {S.strip('pure_answer')} THEN 1.0 ELSE 0.0 END::DOUBLE
               AS stat_accuracy_reward,
             {S.fmt_all('r')} AS stat_format_all_reward,
             {lst} AS l FROM j),
t AS (SELECT *, CASE WHEN l IS NOT NULL AND len(list_filter(l, lambda v: v IS NULL OR v < 0)) = 0 THEN l ELSE [] END AS lst FROM s)
"""


_TEACHER_SQL = _sql_teacher() + """
SELECT request_index, pure_answer, stat_accuracy_reward, stat_format_all_reward, len(lst) AS n_reward_values,
       coalesce(len(lst) = 2 AND lst[1] = stat_accuracy_reward AND lst[2] = stat_format_all_reward, false) AS stat_rewrew_right
FROM t
"""


def teacher_stats(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return OC.curate_teacher_output(teacher_raw(spark, sf_dir), qa_hash(spark, sf_dir), strict=strict)


@query("teacher_curation", ids=("J1", "C1", "C2", "R4", "R19", "R21", "R22"), sql=_TEACHER_SQL)
def q_teacher_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question from request text → gold lookup by question → tag renames → accuracy/format/self-grade stats."""
    s = teacher_stats(spark, sf_dir)
    return s.select(
        "request_index",
        "pure_answer",
        "stat_accuracy_reward",
        "stat_format_all_reward",
        F.size("stat_rewarding_reward").alias("n_reward_values"),
        "stat_rewrew_right",
    )


_TOTALS_SQL = _sql_teacher() + """,
u AS (SELECT *, coalesce(len(lst) = 2 AND lst[1] = stat_accuracy_reward AND lst[2] = stat_format_all_reward, false) AS ok FROM t)
SELECT sum(coalesce(stat_accuracy_reward, 0.0)) AS accuracy_total, CAST(sum(stat_format_all_reward) AS BIGINT) AS format_total,
       count(*) FILTER (WHERE ok) AS rewrew_total, count(*) AS n
FROM u
"""


@query("teacher_totals", ids=("A1",), sql=_TOTALS_SQL)
def q_teacher_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OC.totals(teacher_stats(spark, sf_dir))


_TEACHER_RFT_SQL = _sql_teacher() + f""",
u AS (SELECT t.*, coalesce(len(lst) = 2 AND lst[1] = stat_accuracy_reward AND lst[2] = stat_format_all_reward, false) AS ok,
             qa.question, qa.answer FROM t JOIN qa_hash qa ON t.request_index = qa.index)
SELECT request_index, {_lit(FM.SYSTEM_PROMPTS[('gsm8k', 'ta')])} AS system, question AS user,
       {_sql_hash_answer('answer')} AS solution, ok AS rewrew_valid, md5(r) AS taer_response_md5
FROM u
"""


@query("teacher_rft_records", ids=("F3", "F4"), sql=_TEACHER_RFT_SQL)
def q_teacher_rft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher-checked records → RFT records with ``rewrew_valid`` and the raw response (``ta`` prompt)."""
    s = teacher_stats(spark, sf_dir)
    recs = FM.formatter_for("gsm8k_teacher", "rft")(s, using_prompt="ta", keep=["request_index"])
    return recs.select(
        "request_index",
        F.col("prompt")[0]["content"].alias("system"),
        F.col("prompt")[1]["content"].alias("user"),
        "solution",
        "rewrew_valid",
        F.md5("taer_response").alias("taer_response_md5"),
    )


def bool_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in bool QA: labelled documents → question, boolean answer, facts."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    j = lab.join(docs, "doc_id", "inner")
    return j.select(
        "doc_id",
        F.concat(F.lit("Is this passage high quality? "), F.col("text")).alias("question"),
        (F.col("quality") == 1).alias("answer"),
        F.split("text", "\n").alias("facts"),
        F.when(F.col("toxic") == 1, F.lit(" TRUE ")).when(F.col("quality") == 1, F.lit("false")).otherwise(F.lit("maybe")).alias(
            "model_answer"
        ),
    )


_BOOL_SQL = f"""
WITH b AS (SELECT l.doc_id, concat('Is this passage high quality? ', d.text) AS question,
                  l.quality = 1 AS answer, string_split(d.text, chr(10)) AS facts,
                  CASE WHEN l.toxic = 1 THEN ' TRUE ' WHEN l.quality = 1 THEN 'false' ELSE 'maybe' END AS model_answer
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT doc_id, {_lit(FM.SYSTEM_PROMPTS[('strategyqa', 'ta')])} AS system, question AS user,
       concat('<think>', array_to_string(facts, ' '), '</think>' || chr(10) || '<answer>',
              CASE WHEN answer THEN 'True' ELSE 'False' END, '</answer>') AS completion,
       coalesce((CASE lower({S.strip('model_answer')}) WHEN 'true' THEN true WHEN 'false' THEN false END) = answer, false)
         AS model_correct
FROM b
"""


@query("strategyqa_records", ids=("F5", "F6", "R3"), sql=_BOOL_SQL)
def q_strategyqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bool QA with facts → SFT records; boolean answer check of a model answer."""
    b = bool_qa(spark, sf_dir)
    recs = FM.strategyqa_sft(b, keep=["doc_id", "answer", "model_answer"])
    return recs.select(
        "doc_id",
        F.col("prompt")[0]["content"].alias("system"),
        F.col("prompt")[1]["content"].alias("user"),
        F.col("completion")[0]["content"].alias("completion"),
        R.verify_bool("model_answer", "answer").alias("model_correct"),
    )


def multiple_choice_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in multiple-choice rows: Problem, options, correct, Rationale (quoted)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    opts = F.concat_ws(
        " , ", *[F.concat(F.lit(f"{ch} ) "), ((F.col("n_chars") + i) % 97).cast("string")) for i, ch in enumerate("abcde")]
    )
    return d.select(
        "doc_id",
        F.col("text").alias("Problem"),
        opts.alias("options"),
        F.concat(F.lit(" "), F.substring(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), 1), F.lit(" ")).alias("correct"),
        F.concat(F.lit('"'), F.col("text"), F.lit('"')).alias("Rationale"),
    )


_MC_SQL = f"""
WITH m AS (SELECT doc_id, text AS problem,
                  concat_ws(' , ', {", ".join(f"concat('{ch} ) ', cast((n_chars + {i}) % 97 AS varchar))" for i, ch in enumerate("abcde"))}) AS options,
                  concat(' ', substring('ABCDE', CAST(doc_id % 5 + 1 AS INTEGER), 1), ' ') AS correct,
                  concat('"', text, '"') AS rationale FROM documents),
f AS (SELECT doc_id, concat(problem, chr(10) || 'Options: ', options) AS question, lower({S.strip('correct')}) AS answer,
             regexp_replace(regexp_replace(rationale, '^"', ''), '"$', '') AS rationale FROM m)
SELECT doc_id, question AS user, answer, split_part(question, chr(10) || 'Options: ', 1) AS problem_back,
       concat('<think>', rationale, '</think>' || chr(10) || '<answer>', answer, '</answer>') AS completion
FROM f
"""


@query("mathqa_records", ids=("F9", "F10", "C4", "C5"), sql=_MC_SQL)
def q_mathqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple choice: question with options, unquoted rationale, lower-cased letter → SFT records."""
    m = multiple_choice_raw(spark, sf_dir)
    f = m.select(
        "doc_id",
        CU.question_with_options("Problem", "options").alias("question"),
        CU.gold_choice("correct").alias("answer"),
        CU.strip_one_quote("Rationale").alias("rationale"),
    )
    recs = FM.mathqa_sft(f, keep=["doc_id", "answer", "question"])
    return recs.select(
        "doc_id",
        F.col("prompt")[1]["content"].alias("user"),
        "answer",
        CU.problem_from_question("question").alias("problem_back"),
        F.col("completion")[0]["content"].alias("completion"),
    )


_REQ_SQL = f"""
WITH {S.QA_HASH.strip()}
SELECT concat('train_', lpad(cast(row_number() OVER (ORDER BY index) - 1 AS varchar), 6, '0')) AS custom_id,
       {_lit(FM.SYSTEM_PROMPTS[('gsm8k', 'taer')])} AS system_content,
       replace('Question: {{prompt}}', '{{prompt}}', question) AS user_content, 4096 AS max_tokens
FROM qa_hash
"""


@query("batch_requests", ids=("SNK4", "C10", "W4"), sql=_REQ_SQL)
def q_batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch-request rows: ``split_%06d`` ids in index order, templated user turn, token cap."""
    q = qa_hash(spark, sf_dir)
    out = OC.batch_request_rows(q, "index", "question", "train", FM.SYSTEM_PROMPTS[("gsm8k", "taer")], "Question: {prompt}", 4096)
    return out.select(
        "custom_id",
        F.col("body.messages")[0]["content"].alias("system_content"),
        F.col("body.messages")[1]["content"].alias("user_content"),
        "max_tokens",
    )


_CHAT_SQL = """
WITH c AS (SELECT conv_id, count(*) AS n_turns,
                  string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '' ORDER BY turn) AS rendered,
                  string_agg(CASE WHEN role IN ('system', 'user') THEN concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) ELSE '' END, '' ORDER BY turn) AS kept,
                  arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text
           FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, md5(rendered) AS rendered_md5,
       md5(concat(kept, '<|im_start|>assistant' || chr(10) || 'ok<|im_end|>' || chr(10))) AS rebuilt_md5,
       md5(concat(substring(rendered, 1, length(rendered) - 11), chr(10) || '<evaluation>')) AS cue_md5,
       md5(CASE WHEN last_role = 'assistant' THEN concat(last_text, 'DONE') ELSE 'DONE' END) AS prefilled_md5
FROM c
"""


@query("chat_render", ids=("C12", "C15", "C16", "C17"), sql=_CHAT_SQL)
def q_chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations → ordered messages → ChatML text; prompt-only rebuild; evaluation cue; prefill."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    msgs = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_m")
    )
    msgs = msgs.select("conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("msgs"))
    rendered = CU.render_chatml("msgs")
    return msgs.select(
        "conv_id",
        F.size("msgs").alias("n_turns"),
        F.md5(rendered).alias("rendered_md5"),
        F.md5(CU.render_chatml(CU.with_assistant("msgs", F.lit("ok")))).alias("rebuilt_md5"),
        F.md5(CU.evaluation_cue(rendered)).alias("cue_md5"),
        F.md5(CU.with_assistant_prefill("msgs", F.lit("DONE"))).alias("prefilled_md5"),
    )


_EXP_SQL = f"""
WITH {S.ROLLOUTS.strip()},
gen AS (SELECT concat('exp_', cast(gen_idx AS varchar)) AS exp, prompt_id AS index, completion AS generated_result FROM rollouts),
gold AS (SELECT DISTINCT prompt_id AS index, gold AS ground_truth FROM rollouts),
sel AS (SELECT * FROM gen WHERE starts_with(exp, 'exp_') AND NOT starts_with(exp, 'exp_3')),
per AS (SELECT exp, count(*) AS n_rows FROM sel GROUP BY exp),
acc AS (SELECT exp, round_even(avg(CASE WHEN {S.answer('generated_result')} = {S.strip('ground_truth')} THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy
        FROM sel JOIN gold USING (index) GROUP BY exp)
SELECT per.exp, n_rows, accuracy FROM per JOIN acc USING (exp) WHERE n_rows = (SELECT count(*) FROM gold)
"""


@query("experiment_accuracy", ids=("J7", "A2", "P10"), sql=_EXP_SQL)
def q_experiment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files per experiment ⋈ gold on index → accuracy ×100; experiments picked by prefix."""
    r = rollouts(spark, sf_dir)
    gen = r.select(
        F.concat(F.lit("exp_"), F.col("gen_idx").cast("string")).alias("exp"),
        F.col("prompt_id").alias("index"),
        F.col("completion").alias("generated_result"),
    )
    gold = r.select(F.col("prompt_id").alias("index"), F.col("gold").alias("ground_truth")).distinct()
    sel = OC.select_experiments(gen, "exp", include=["exp_"], exclude=["exp_3"])
    correct = R.verify_exact(R.extract_answer("generated_result"), F.col("ground_truth"))
    return OC.experiment_accuracy(sel, gold, correct, exp="exp", key="index")


_PREP_SQL = f"""
WITH {S.ROLLOUTS.strip()}
SELECT doc_id,
       md5(CASE WHEN instr(completion, '</answer>') > 0 THEN concat(split_part(completion, '</answer>', 1), '</answer>') ELSE completion END) AS truncated_md5,
       md5(CASE WHEN suffix(completion, '<|im_end|>') THEN completion ELSE concat(completion, '<|im_end|>') END) AS with_eos_md5,
       instr(completion, '<evaluation>') = 0 AS missing_evaluation,
       CASE WHEN length(completion) > 200 THEN concat(substring(completion, 1, 200), '...') ELSE completion END AS preview
FROM rollouts
"""


@query("completion_prep", ids=("R34", "C13", "P3", "P6", "P9"), sql=_PREP_SQL)
def q_completion_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at the stop string, append EOS, flag missing evaluation, preview (rename sft_completion → completion)."""
    r = OC.rename_if_present(rollouts(spark, sf_dir).withColumnRenamed("completion", "sft_completion"), "sft_completion", "completion")
    r = r.withColumn("missing_evaluation", ~F.col("completion").contains("<evaluation>"))
    p = OC.preview(r.withColumn("preview", F.col("completion")), "preview", 200)
    return p.select(
        "doc_id",
        F.md5(truncate_at("completion", "</answer>")).alias("truncated_md5"),
        F.md5(CU.append_eos("completion", "<|im_end|>")).alias("with_eos_md5"),
        "missing_evaluation",
        "preview",
    )
