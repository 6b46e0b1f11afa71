"""Jobs over inputs that reach the rarer branches: uniform groups, strict reports, boxed fractions, drifted joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import report as RP
from ..functions import rewards as R
from ..functions.text import split_words
from ..operators import curate as OC
from ..operators import decontam as D
from ..operators import groups as G
from ..operators.ranking import global_row_number
from ..operators.tokenize import tokenizer_hook
from ..sources import io as IO
from ..sources.fixtures import branch_rollouts, qa_hash, rollouts
from ..sources.tables import read_table
from ..streaming.jobs import scratch_dir
from . import sqltext as S
from .cleaning import NGRAM
from .curation import _lit
from .extras import SEED, report_sql
from .registry import query
from .scoring import DEC, _sql_answer_text, _sql_norm_math, _sql_reward_list, _sql_to_number, score_and_advantage

# ---------------------------------------------------------------------------
# Rewards and groups
# ---------------------------------------------------------------------------
_ADV_SQL = f"""
WITH {S.BRANCH_ROLLOUTS.strip()},
t AS (SELECT prompt_id, doc_id, coalesce({S.accuracy('completion', 'solution')}, 0.0) + {S.fmt('completion')} AS reward FROM rollouts),
g AS (SELECT prompt_id, avg(reward) AS m, stddev_samp(reward) AS sd FROM t GROUP BY prompt_id)
SELECT doc_id, CAST(reward AS DOUBLE) AS reward, abs(sd) <= 1e-8 AS std_is_zero, round((reward - m) / (sd + 1e-4), {DEC}) AS advantage
FROM t JOIN g ON t.prompt_id = g.prompt_id
"""


@query("advantage_of_uniform_groups", ids=("W1", "W2", "A5"), sql=_ADV_SQL)
def q_uniform_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantages where whole groups have one reward: zero spread is flagged and the advantage is 0."""
    a = score_and_advantage(branch_rollouts(spark, sf_dir))
    return a.select("doc_id", "reward", "std_is_zero", F.round("advantage", DEC).alias("advantage"))


_MISSING_SQL = f"""
WITH {S.BRANCH_ROLLOUTS.strip()},
s AS (SELECT doc_id, {S.accuracy('completion', 'solution')} AS a, CASE WHEN gen_idx = 0 THEN 1.0 END AS b FROM rollouts)
SELECT doc_id FROM s WHERE a IS NULL AND b IS NULL
"""


@query("rewards_missing_rows", ids=("A21",), sql=_MISSING_SQL)
def q_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without any reward: the gold cannot be read, and the second reward only judges first generations."""
    s = branch_rollouts(spark, sf_dir).select(
        "doc_id", R.accuracy_reward("completion", "solution").alias("a"), F.when(F.col("gen_idx") == 0, 1.0).alias("b")
    )
    return G.rows_with_all_rewards_missing(s, ["a", "b"]).select("doc_id")


_STEPS = r"least(1.0, len(regexp_extract_all(completion, '(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)')) / 3.0)"

_REWARDS_SQL = f"""
WITH {S.BRANCH_ROLLOUTS.strip()},
n AS (SELECT doc_id, completion, round({_STEPS}, {DEC})::DOUBLE AS reasoning_steps, {_sql_norm_math(_sql_answer_text('completion'))} AS ps,
             {_sql_norm_math(_sql_answer_text('solution'))} AS gs FROM rollouts),
v AS (SELECT *, {_sql_to_number('ps')} AS pv, {_sql_to_number('gs')} AS gv, length(completion) AS len FROM n),
c AS (SELECT *, CASE WHEN gs = '' THEN NULL WHEN pv IS NOT NULL AND gv IS NOT NULL THEN abs(pv - gv) <= 1e-6 * greatest(1.0, abs(gv))
                     ELSE ps = gs END AS correct FROM v)
SELECT doc_id, reasoning_steps, correct,
  round(CASE WHEN correct IS NULL THEN 1.0 WHEN correct THEN 0.5 + 0.25 * (1.0 + cos(len / 1000.0 * pi()))
        ELSE -0.5 - 0.25 * (1.0 + cos(len / 1000.0 * pi())) END, {DEC})::DOUBLE AS cosine
FROM c
"""


@query("reward_branches", ids=("R11", "R12", "R29"), sql=_REWARDS_SQL)
def q_reward_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step markers, boxed fractions against whole numbers, golds that cannot be read."""
    r = branch_rollouts(spark, sf_dir)
    c = r.select("doc_id", "completion", R.math_correct("completion", "solution").alias("correct"))
    return c.select(
        "doc_id",
        F.round(R.reasoning_steps_reward("completion"), DEC).alias("reasoning_steps"),
        "correct",
        F.round(R.cosine_scaled_reward("completion", F.col("correct")), DEC).alias("cosine"),
    )


@query("report_branches", ids=("R25", "R26", "R27", "R28"), sql=report_sql(S.BRANCH_ROLLOUTS, f"round({_STEPS}, 2)::DOUBLE"))
def q_report_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with strict formats, perfect rows, missing tags and a line for another reward."""
    r = branch_rollouts(spark, sf_dir)
    steps = F.round(R.reasoning_steps_reward("completion"), 2)
    rep = RP.evaluation_report(F.col("completion"), F.col("solution"), F.col("doc_id"), seed=SEED, others={"other_reward": steps})
    return r.select(
        "doc_id",
        F.md5(rep).alias("report_md5"),
        RP.evaluation_summary(F.col("completion"), F.col("solution")).alias("summary"),
        RP.missing_tags_report("completion").alias("missing_tags"),
    )


_GRADES = "concat(completion, '<evaluation>x</evaluation><reward>[', CASE doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '-1' ELSE '0.5' END, ', 0]</reward>')"
_RAW_SQL = f"""
WITH {S.ROLLOUTS.strip()},
c AS (SELECT doc_id, solution, {_GRADES} AS completion FROM rollouts),
k AS (SELECT doc_id, solution, split_part(completion, '<evaluation>', 1) AS cut, {_sql_reward_list('completion')} AS p FROM c),
v AS (SELECT *, coalesce({S.accuracy('cut', 'solution')}, 0.0) AS acc, CAST({S.fmt('cut')} AS DOUBLE) AS fmt,
             coalesce(len(p) = 2 AND len(list_filter(p, lambda x: x IS NULL)) = 0, false) AS two FROM k)
SELECT doc_id, two AND p[1] >= 0 AND p[2] >= 0 AS valid, two AS valid_signed,
       CASE WHEN two AND p[1] >= 0 AND p[2] >= 0 THEN [acc, fmt] END AS gt, CASE WHEN two THEN p END AS dt_signed
FROM v
"""


@query("self_grades_raw", ids=("R19", "R21"), sql=_RAW_SQL)
def q_self_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and self-grade side by side, with negative grades rejected and kept."""
    grade = F.when(F.col("doc_id") % 3 == 0, "1").when(F.col("doc_id") % 3 == 1, "-1").otherwise("0.5")
    c = F.concat("completion", F.lit("<evaluation>x</evaluation><reward>["), grade, F.lit(", 0]</reward>"))
    r = rollouts(spark, sf_dir).withColumn("completion", c)
    strict = R.rewarding_reward_raw("completion", "solution")
    signed = R.rewarding_reward_raw("completion", "solution", reject_negative=False)
    return r.select(
        "doc_id", strict["valid"].alias("valid"), signed["valid"].alias("valid_signed"), strict["gt"].alias("gt"), signed["dt"].alias("dt_signed")
    )


# ---------------------------------------------------------------------------
# Decontamination against several sets, and above the broadcast bound
# ---------------------------------------------------------------------------
def _sets_by_parity(spark: SparkSession, sf_dir: str) -> dict:
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return {"odd": (b.filter(F.col("item_id") % 2 == 1), "text"), "all": (b, "text")}


_PARITY = f"""
dg AS ({S.ngrams_of('documents', 'doc_id', 'text', NGRAM)}),
bg AS (SELECT g, max(item_id % 2) AS odd FROM ({S.ngrams_of('benchmark', 'item_id', 'text', NGRAM)}) GROUP BY g),
h AS (SELECT doc_id, max(odd) AS odd FROM dg JOIN bg USING (g) GROUP BY doc_id)"""


@query(
    "decontaminate_counts_in_order",
    ids=("A20", "J4"),
    sql=f"WITH {_PARITY.strip()} SELECT CASE WHEN odd = 1 THEN 'odd' ELSE 'all' END AS benchmark, count(*) AS removed FROM h GROUP BY 1",
)
def q_counts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals by two evaluation sets that overlap: a document that both hit counts for the first."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    flagged = D.decontaminate(docs, _sets_by_parity(spark, sf_dir), key="doc_id", text="text", n=NGRAM)
    return D.removal_counts(flagged, ["contaminated_odd", "contaminated_all"])


@query(
    "decontaminate_by_filter",
    ids=("C8", "J4"),
    sql=f"""WITH {_PARITY.strip()}
SELECT d.doc_id, coalesce(h.odd = 1, false) AS contaminated_odd, h.doc_id IS NOT NULL AS contaminated_all
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""",
)
def q_decontaminate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags with the broadcast bound at 0: a Bloom filter is probed in the scan, the rest is shuffled."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    flagged = D.decontaminate(docs, _sets_by_parity(spark, sf_dir), key="doc_id", text="text", n=NGRAM, max_broadcast_rows=0)
    return flagged.select("doc_id", "contaminated_odd", "contaminated_all")


# ---------------------------------------------------------------------------
# Joins that must notice a disagreement
# ---------------------------------------------------------------------------
_DRIFT_SQL = f"""
WITH {S.QA_HASH.strip()}
SELECT index, question, index % 10 <> 3 AS fields_agree FROM qa_hash
"""


@query("request_merge_with_edits", ids=("J2",), sql=_DRIFT_SQL)
def q_merge_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests joined to raw rows by id, where every tenth question was edited since: those rows disagree."""
    q = qa_hash(spark, sf_dir)
    edited = F.when(F.col("index") % 10 == 3, F.concat("question", F.lit(" (edited)"))).otherwise(F.col("question"))
    req = q.select("index", edited.alias("request_question"))
    j = OC.join_checked(req, q.select("index", "question"), "index", "request_question", "question")
    return j.select("index", "question", "fields_agree")


_SHIFT_SQL = """
WITH r AS (SELECT doc_id AS qid, row_number() OVER (ORDER BY doc_id) AS pos, quality FROM labels),
t AS (SELECT qid, row_number() OVER (ORDER BY qid) AS pos FROM r WHERE pos <> 100)
SELECT t.qid, r.quality, t.pos = r.pos AS fields_agree FROM t JOIN r ON t.qid = r.qid
"""


@query("position_join_with_gap", ids=("J3",), sql=_SHIFT_SQL)
def q_position_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher rows that lack the hundredth raw row: joined by id, the positions after it disagree."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).withColumnRenamed("doc_id", "qid")
    raw = global_row_number(lab, ["qid"], out="raw_pos")
    teacher = global_row_number(raw.filter(F.col("raw_pos") != 100).select("qid"), ["qid"], out="pos")
    j = OC.join_checked(teacher, raw, "qid", "pos", "raw_pos")
    return j.select("qid", "quality", "fields_agree")


# ---------------------------------------------------------------------------
# Files: JSON arrays, batch requests, pruned lookups, previews (SRC2, SRC6, SNK4, J6, P9, X5)
# ---------------------------------------------------------------------------
@query("json_array_files", ids=("SRC2", "SRC5"), sql="SELECT doc_id, quality, toxic FROM labels")
def q_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as JSON array files of 1,000 records each, and read back."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    batch = F.floor(F.coalesce("doc_id", F.lit(0)) / 1000)
    path = scratch_dir(spark, "arrays")
    IO.write_json_arrays(lab.withColumn("batch", batch), path, "batch")
    return IO.read_json_array(spark, path, lab.schema)


_TEMPLATE = "Question: {prompt}"
_BATCH_SQL = f"""
WITH {S.QA_HASH.strip()}
SELECT concat('train_', lpad(CAST(row_number() OVER (ORDER BY index) - 1 AS VARCHAR), 6, '0')) AS custom_id, 2 AS n_messages,
       'be brief' AS system_content, concat({_lit('Question: ')}, question) AS user_content, 4096 AS max_tokens FROM qa_hash
"""


@query("batch_request_files", ids=("SNK4", "SRC3"), sql=_BATCH_SQL)
def q_batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch requests written as JSON lines, at most 500 a file, and read back with their schema."""
    rows = OC.batch_request_rows(qa_hash(spark, sf_dir), "index", "question", "train", "be brief", _TEMPLATE, 4096)
    path = scratch_dir(spark, "requests") + ".jsonl"
    OC.write_batch_requests(rows, path, max_per_file=500)
    back = IO.read_any(spark, path, rows.schema)
    messages = F.col("body.messages")
    return back.select(
        "custom_id",
        F.size(messages).alias("n_messages"),
        messages[0]["content"].alias("system_content"),
        messages[1]["content"].alias("user_content"),
        "max_tokens",
    )


_LOOKUP_SQL = """
WITH p AS (SELECT o_orderkey AS problem_id, o_custkey % 40 AS contest FROM orders WHERE o_custkey % 40 IN (3, 17)),
t AS (SELECT l_orderkey AS problem_id, 0 AS part, l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS input FROM lineitem
      UNION ALL SELECT l_orderkey, 1, l_linenumber, concat('g', l_suppkey) FROM lineitem WHERE l_linenumber % 3 = 0)
SELECT p.problem_id, p.contest, coalesce(list(t.input ORDER BY part, n, t.input) FILTER (t.input IS NOT NULL), []) AS inputs
FROM p LEFT JOIN t ON t.problem_id = p.problem_id GROUP BY 1, 2
"""


@query("contest_tests_pruned", ids=("SRC6", "J6", "A17"), sql=_LOOKUP_SQL)
def q_contest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official and generated tests in folders by contest; only the folders of the wanted problems' contests are read."""
    from ..operators.grading import tests_by_problem

    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    problems = orders.select(F.col("o_orderkey").alias("problem_id"), (F.col("o_custkey") % 40).alias("contest"))
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    li = li.withColumnRenamed("l_orderkey", "problem_id").join(problems, "problem_id")
    name, output = F.lpad(F.col("l_linenumber").cast("string"), 4, "0").alias("test_name"), F.lit("").alias("output")
    official = li.select("problem_id", "contest", name, F.col("l_partkey").cast("string").alias("input"), output)
    generated = li.filter(F.col("l_linenumber") % 3 == 0).select(
        "problem_id", "contest", name, F.concat(F.lit("g"), F.col("l_suppkey").cast("string")).alias("input"), output
    )
    wanted, found = problems.filter(F.col("contest").isin(3, 17)), []
    for kind, tests in (("official", official), ("generated", generated)):
        path = scratch_dir(spark, f"tests-{kind}")
        IO.write_partitioned(tests, path, "contest")
        found.append(IO.read_needed_partitions(spark, path, "contest", wanted))
    out = tests_by_problem(wanted, found[0], generated=found[1])
    return out.select("problem_id", "contest", F.col("test_cases.input").alias("inputs"))


_PREVIEW_SQL = f"""
WITH {S.ROLLOUTS.strip()}
SELECT count(*) AS n_rows, ['doc_id', 'response'] AS fields, arg_min(doc_id, doc_id) AS first_id,
       arg_min(CASE WHEN length(completion) > 200 THEN concat(substring(completion, 1, 200), '...') ELSE completion END, doc_id) AS first_response
FROM rollouts
"""


@query("dataset_preview", ids=("P9",), sql=_PREVIEW_SQL)
def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, field names and first record of a response table, its long text cut."""
    r = rollouts(spark, sf_dir).select("doc_id", F.col("completion").alias("response"))
    p = OC.dataset_preview(r, "doc_id")
    first = F.from_json("first_row", "doc_id BIGINT, response STRING")
    return p.select("n_rows", "fields", first["doc_id"].alias("first_id"), first["response"].alias("first_response"))


_HOOK_SQL = f"""
SELECT doc_id, list_transform({S.words('text')}, lambda w: CAST(length(w) * 100 + length(w) - length(replace(w, 'e', '')) AS INTEGER)) AS input_ids
FROM documents
"""


@query("token_ids_hook", ids=("X5", "T1"), sql=_HOOK_SQL)
def q_token_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's tokenizer plugged in as a column function: ids from a word's length and its letters e."""

    def shapes(text):
        return F.transform(split_words(text), lambda w: F.length(w) * 100 + F.length(w) - F.length(F.replace(w, F.lit("e"), F.lit(""))))

    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return tokenizer_hook(shapes)(d, "text").select("doc_id", "input_ids")
