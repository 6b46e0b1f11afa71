"""File source and sink jobs: JSONL round trips, malformed lines, chunked publish and merge."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups as G
from ..functions import rewards as R
from ..sources import io as IO
from ..sources.fixtures import rollouts
from ..sources.tables import read_table
from ..streaming.jobs import scratch_dir
from . import sqltext as S
from .registry import query

_GEN_SCHEMA = "index BIGINT, question STRING, ground_truth STRING, generated_result STRING, prompt STRING"

_JSONL_SQL = f"""
WITH {S.ROLLOUTS.strip()}
SELECT doc_id AS index, {S.answer('completion')} AS answer, gold AS ground_truth, length(completion) AS n_chars
FROM rollouts
"""


@query("jsonl_roundtrip", ids=("SNK1", "SRC3", "SRC5"), sql=_JSONL_SQL)
def q_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation records written as JSON lines (UTF-8 kept) and read back with a schema."""
    r = rollouts(spark, sf_dir).select(
        F.col("doc_id").alias("index"),
        F.lit("q").alias("question"),
        F.col("gold").alias("ground_truth"),
        F.col("completion").alias("generated_result"),
        F.lit("p").alias("prompt"),
    )
    path = scratch_dir(spark, "gen") + ".jsonl"
    IO.write_jsonl(r, path)
    back = IO.read_any(spark, path, _GEN_SCHEMA)
    return back.select(
        "index",
        R.extract_answer("generated_result").alias("answer"),
        "ground_truth",
        F.length("generated_result").alias("n_chars"),
    )


_MALFORMED_SQL = "SELECT doc_id, source FROM documents WHERE lang <> 'de'"


@query("jsonl_skip_malformed", ids=("SRC4",), sql=_MALFORMED_SQL)
def q_jsonl_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines where the German documents' records are cut mid-line: those lines are skipped, the rest read."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "lang"])
    line = F.to_json(F.struct("doc_id", "source"))
    broken = F.when(F.col("lang") == "de", F.substring(line, 1, 12)).otherwise(line)
    path = scratch_dir(spark, "lines")
    d.select(broken.alias("value")).write.mode("overwrite").text(path)
    return IO.read_jsonl(spark, path, "doc_id BIGINT, source STRING", skip_malformed=True)


_PUBLISH_SQL = f"""
WITH {S.ROLLOUTS.strip()},
p AS (SELECT prompt_id, avg({S.accuracy('completion', 'solution')}) AS pass_rate FROM rollouts GROUP BY prompt_id)
SELECT prompt_id, pass_rate, CASE WHEN pass_rate > 0.1 AND pass_rate < 0.9 THEN 'filt-0.1-0.9' ELSE 'gen-all' END AS config
FROM p
"""


@query("publish_and_merge", ids=("SNK2", "SNK3", "SNK6"), sql=_PUBLISH_SQL)
def q_publish_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates published as two configs (kept band / the rest), re-publish skipped, merged back."""
    r = rollouts(spark, sf_dir).select("prompt_id", R.accuracy_reward("completion", "solution").alias("acc"))
    rates = G.pass_rates(r, "acc").select("prompt_id", "pass_rate")
    kept = G.filter_pass_rate(rates, 0.1, 0.9)
    rest = rates.join(kept.select("prompt_id"), "prompt_id", "left_anti")
    root = scratch_dir(spark, "published")
    IO.publish(kept.withColumn("config", F.lit(IO.config_name("filt", 0.1, 0.9))), root, IO.config_name("filt", 0.1, 0.9))
    IO.publish(rest.withColumn("config", F.lit("gen-all")), root, "gen-all")
    IO.publish(rest.withColumn("config", F.lit("gen-all")), root, "gen-all", mode="ignore")  # exists → skipped
    return IO.merge_configs(spark, root, "*", schema=None).select("prompt_id", "pass_rate", "config")


_PARTITION_SQL = """
SELECT l_partkey % 100 AS contest, count(*) AS n_tests, count(DISTINCT l_orderkey) AS n_problems,
       CAST(sum(l_suppkey) AS BIGINT) AS output_sum
FROM lineitem GROUP BY l_partkey % 100
"""


@query("partitioned_tests_lookup", ids=("SRC6",), sql=_PARTITION_SQL)
def q_partitioned_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests written one folder per contest (part key mod 100), read back as one partitioned dataset."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    tests = li.select(
        F.col("l_orderkey").alias("problem_id"),
        F.col("l_linenumber").alias("test_no"),
        F.col("l_suppkey").cast("string").alias("output"),
        (F.col("l_partkey") % 100).alias("contest"),
    )
    path = scratch_dir(spark, "tests")
    IO.write_partitioned(tests, path, "contest")
    back = spark.read.parquet(path)
    return back.groupBy("contest").agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.countDistinct("problem_id").alias("n_problems"),
        F.sum(F.col("output").cast("bigint")).alias("output_sum"),
    )
