"""SRC1: named tables read from a folder of parquet files.

Reads are lazy; Catalyst prunes columns and pushes filters into the scan, so
callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(
    spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, spread: bool | None = None
) -> DataFrame:
    """Load one named table; optional column list is applied as a projection.

    ``spread`` shuffles the selected columns round-robin over the default
    parallelism. It is meant for test files of one row group, whose scan cannot
    be split; unset, the session's ``spark.kiln.spread`` decides (off by default).
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    if spread is None:
        spread = spark.conf.get("spark.kiln.spread", "false") == "true"
    return df.repartition(spark.sparkContext.defaultParallelism) if spread else df


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views for SQL users (same names as the files)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
