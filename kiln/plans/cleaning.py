"""Corpus cleaning jobs: benchmark decontamination, exact dedup, resume (Clean family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decontam as D
from ..sources.tables import read_table
from . import sqltext as S
from .registry import query

NGRAM = 8


def _benchmarks(spark: SparkSession, sf_dir: str) -> dict:
    """Two evaluation sets: the benchmark items and the conversation turns."""
    return {
        "benchmark": (read_table(spark, sf_dir, "benchmark", ["text"]), "text"),
        "conversations": (read_table(spark, sf_dir, "conversations", ["text"]), "text"),
    }


def flagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return D.decontaminate(docs, _benchmarks(spark, sf_dir), key="doc_id", text="text", n=NGRAM)


_HITS = f"""
dg AS ({S.ngrams_of('documents', 'doc_id', 'text', NGRAM)}),
bg AS (SELECT DISTINCT g FROM ({S.ngrams_of('benchmark', 'item_id', 'text', NGRAM)})),
cg AS (SELECT DISTINCT g FROM ({S.ngrams_of('conversations', 'conv_id', 'text', NGRAM)})),
hb AS (SELECT DISTINCT doc_id FROM dg JOIN bg USING (g)),
hc AS (SELECT DISTINCT doc_id FROM dg JOIN cg USING (g)),
flags AS (SELECT d.doc_id, d.lang, d.source, d.text,
                 hb.doc_id IS NOT NULL AS contaminated_benchmark,
                 hc.doc_id IS NOT NULL AS contaminated_conversations
          FROM documents d LEFT JOIN hb ON d.doc_id = hb.doc_id LEFT JOIN hc ON d.doc_id = hc.doc_id)"""

_FLAGS_SQL = f"""WITH {_HITS}
SELECT doc_id, lang, source, contaminated_benchmark, contaminated_conversations FROM flags"""


@query("decontaminate_flags", ids=("C6", "C7", "C8", "J4", "U2"), sql=_FLAGS_SQL)
def q_decontaminate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-gram overlap of every document with two evaluation sets → one flag per set."""
    return flagged_documents(spark, sf_dir).select(
        "doc_id", "lang", "source", "contaminated_benchmark", "contaminated_conversations"
    )


_CLEAN_SQL = f"""WITH {_HITS}
SELECT doc_id, lang, source, md5(text) AS text_md5 FROM flags
WHERE NOT contaminated_benchmark AND NOT contaminated_conversations"""


@query("decontaminate_cleanup", ids=("C8", "P4"), sql=_CLEAN_SQL)
def q_decontaminate_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop contaminated rows and the flag columns."""
    clean = D.cleanup(flagged_documents(spark, sf_dir))
    return clean.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


_COUNTS_SQL = f"""WITH {_HITS}
SELECT benchmark, count(*) AS removed FROM (
  SELECT CASE WHEN contaminated_benchmark THEN 'benchmark'
              WHEN contaminated_conversations THEN 'conversations' END AS benchmark FROM flags)
WHERE benchmark IS NOT NULL GROUP BY benchmark"""


@query("decontaminate_removal_counts", ids=("A20",), sql=_COUNTS_SQL)
def q_removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagged_documents(spark, sf_dir)
    return D.removal_counts(f, ["contaminated_benchmark", "contaminated_conversations"])


_DEDUP_SQL = f"""
SELECT doc_id, lang, source FROM (
  SELECT doc_id, lang, source,
         row_number() OVER (PARTITION BY md5(array_to_string({S.words('text')}, ' ')) ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1"""


@query("dedup_exact", ids=("U3",), sql=_DEDUP_SQL)
def q_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the first document (smallest id) of each normalised text."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return D.exact_dedup(docs, "doc_id", "text").select("doc_id", "lang", "source")


_RESUME_SQL = """
SELECT doc_id, source FROM documents
WHERE md5(cast(doc_id AS varchar)) NOT IN (SELECT md5(cast(doc_id AS varchar)) FROM labels)"""


@query("resume_pending", ids=("J5", "C9"), sql=_RESUME_SQL)
def q_resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents still to generate: those whose md5 id is not in the labelled output."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    done = read_table(spark, sf_dir, "labels", ["doc_id"])
    return D.resume_pending(docs, done, "doc_id", "doc_id")
