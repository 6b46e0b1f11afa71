"""File sources and sinks (SRC2–SRC6, SNK1–SNK3, SNK6).

Readers always take an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

JSON_EXTENSIONS = (".json", ".jsonl")
_BAD = "_malformed_line"


# SRC2
def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file holding one JSON array of objects."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


# SRC3 / SRC4
def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, skip_malformed: bool = False) -> DataFrame:
    """JSON lines; ``skip_malformed`` drops lines that do not parse against the whole schema.

    Lines are judged before columns are selected, so the rows that stay do not
    depend on the columns a query reads.
    """
    if not skip_malformed:
        return spark.read.schema(schema).json(path)
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = StructType([*fields.fields, StructField(_BAD, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", marked, options).alias("r"))
    return parsed.filter(F.col(f"r.{_BAD}").isNull()).select(*[F.col(f"r.`{f.name}`") for f in fields])


# SRC5
def read_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``.json``/``.jsonl`` → JSON lines, anything else → Parquet."""
    if path.rstrip("/").endswith(JSON_EXTENSIONS):
        return read_jsonl(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


# SRC6
def write_partitioned(df: DataFrame, path: str, partition_col: str, mode: str = "overwrite", salts: int = 4) -> None:
    """One parquet folder per value (e.g. contest id); later reads prune by partition.

    Rows are clustered by value first, so a folder gets at most ``salts`` files and
    a large value is written by as many tasks.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != partition_col]), F.lit(salts))
    df.repartition(F.col(partition_col), salt).write.mode(mode).partitionBy(partition_col).parquet(path)


def read_partition(spark: SparkSession, path: str, partition_col: str, value) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(partition_col) == F.lit(value))


def read_needed_partitions(spark: SparkSession, path: str, partition_col: str, needed: DataFrame) -> DataFrame:
    """Rows of the folders whose value stands in ``needed`` (its column ``partition_col``).

    The distinct values are broadcast (there are no more of them than folders),
    and the same broadcast prunes the folders at run time (dynamic partition
    pruning), so ``needed`` may be any filtered query and the others are not read.
    """
    values = needed.select(partition_col).distinct()
    return spark.read.parquet(path).join(F.broadcast(values), partition_col, "left_semi")


# SNK1
def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", max_records_per_file: int = 0) -> None:
    """JSON lines in UTF-8 (non-ASCII characters are written as is); 0: no bound on a file's lines."""
    df.write.mode(mode).option("encoding", "UTF-8").option("maxRecordsPerFile", max_records_per_file).json(path)


def write_json_arrays(df: DataFrame, path: str, batch: str, mode: str = "overwrite") -> None:
    """One JSON array of objects for each value of ``batch``, each in a file of its own (a batch is one row)."""
    rows = [c for c in df.columns if c != batch]
    packed = df.groupBy(batch).agg(F.to_json(F.collect_list(F.struct(*rows)), {"ignoreNullFields": "false"}).alias("value"))
    packed.select("value").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


# SNK2
def config_name(kind: str, *bounds) -> str:
    """Dataset config names: ``gen-<start>-<end>``, ``filt-<min>-<max>[-<start>-<end>]``."""
    return "-".join([kind, *[str(b) for b in bounds]])


def publish(df: DataFrame, root: str, config: str, mode: str = "overwrite") -> str:
    """Write a dataset config as ``<root>/<config>`` (parquet); SNK3: ``mode="ignore"`` skips existing."""
    path = os.path.join(root, config)
    df.write.mode(mode).parquet(path)
    return path


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster filesystem (HDFS, object stores, local)."""
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """A short text as one file on the cluster filesystem (metadata; rows go through DataFrame writers)."""
    fs, p = _fs_and_path(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_small_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs_and_path(spark, path)
    data = fs.open(p)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def rename_into_place(spark: SparkSession, staged: str, path: str) -> bool:
    """Give a finished file its name by one rename; False (and the file is gone) if the name is taken."""
    fs, p = _fs_and_path(spark, path)
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    done = not fs.exists(p) and bool(fs.rename(source, p))
    if not done:
        fs.delete(source, False)
    return done


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Expand a glob on the cluster filesystem into concrete paths (sorted)."""
    fs, p = _fs_and_path(spark, pattern)
    found = fs.globStatus(p)
    return sorted(str(st.getPath().toString()) for st in (found or []))


# SNK6
def merge_configs(spark: SparkSession, root: str, pattern: str, schema: StructType | None = None) -> DataFrame:
    """Read every config folder matching a glob under ``root`` as one dataset."""
    paths = glob_paths(spark, os.path.join(root, pattern))
    if not paths:
        raise FileNotFoundError(f"no dataset config matches {pattern!r} under {root}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(*paths)
