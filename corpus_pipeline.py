"""The training-data pipeline: five stages over ``documents``, each written before the next reads it.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of
``documents``; the last returns ids and their digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.bpe import decode, encode
from kiln.llm.common import delete_path, n_words, read, shared_path
from kiln.llm.line_runs import dedup_table
from kiln.llm.mixing import mix_sources
from kiln.llm.near_dedup import near_duplicates
from kiln.llm.quality_rules import apply_cutoffs, choose_by_sequence, saved, with_metrics
from kiln.operators.sizing import broadcast_if_small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the rules fitted on their language's labelled holdout.

    Null and empty texts have no words and go.
    """
    docs = docs.select(*COLUMNS)
    digest = F.xxhash64("text")
    held = saved(with_metrics(docs.select("doc_id", "lang", "text")).withColumn("_digest", digest).drop("text"))
    judged = apply_cutoffs(held, choose_by_sequence(held, read(spark, sf_dir, "labels")))
    gone = saved(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), "_digest").distinct())
    side, _ = broadcast_if_small(gone, max_rows=500_000, max_bytes=32 << 20)
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in at least three documents (the largest id keeps its own).

    ``n_chars`` follows the text. A document that loses all its lines stays, empty.
    """
    kept = dedup_table(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id stays. Documents without words are linked with nothing and stay.
    """
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    gone = saved(found.filter(~F.col("kept")).select("doc_id").distinct())
    side, _ = broadcast_if_small(gone, max_rows=500_000, max_bytes=32 << 20)
    return docs.join(side, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document stands as often as the mix takes it."""
    docs = docs.select(*COLUMNS)
    size = n_words(F.col("text"))
    drawn = mix_sources(docs, size).filter("copies > 0")
    drawn = saved(
        drawn.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    )
    side, _ = broadcast_if_small(drawn, max_rows=500_000, max_bytes=32 << 20)
    key = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    )
    return docs.join(side, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and digests of ids and decoded text.

    The ids are written before they are decoded: a task that does both at once holds two Python workers.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = saved(encode(docs.select("doc_id", "source", "text"), path).drop("text"))
    digests = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    out = decode(ids.withColumn("ids_sha256", digests), path)
    return out.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("bpe_encode_decode", tokenize),
]

#: Sampling and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage no longer needs is deleted."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
