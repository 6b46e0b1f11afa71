"""Replay-safe output of streams: a manifest of committed epochs (ST2, SNK5).

A micro-batch is written to a folder of its own attempt,
``<out>/run=<run>/epoch=<n>/attempt=<id>``, and counts only once its manifest
file ``<out>/_manifest/<run>.<n>`` exists, which names the attempt and is put in
place by one rename. So a stream that dies

* while it writes, or before the manifest, leaves an attempt nobody reads, and
  the replayed batch writes a new one;
* after the manifest, but before Spark's own commit log, finds the epoch
  committed when it is replayed, and writes nothing.

``run`` is the streaming query's id, which its checkpoint keeps. Readers go by
the manifest only. What reaches the driver is one short name for each epoch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.io import glob_paths, path_exists, read_small_text, rename_into_place, write_small_text

_MANIFEST = "_manifest"


def _entry(out_path: str, run: str, epoch: int) -> str:
    return f"{out_path}/{_MANIFEST}/{run}.{epoch}"


def is_committed(spark: SparkSession, out_path: str, run: str, epoch: int) -> bool:
    return path_exists(spark, _entry(out_path, run, epoch))


def commit(spark: SparkSession, out_path: str, run: str, epoch: int, attempt: str) -> bool:
    """Name ``attempt`` as the epoch's rows; False if another attempt was first."""
    staged = f"{out_path}/{_MANIFEST}/.{uuid.uuid4().hex}"
    write_small_text(spark, staged, attempt)
    return rename_into_place(spark, staged, _entry(out_path, run, epoch))


def committed_paths(spark: SparkSession, out_path: str) -> list[str]:
    """Folders of all committed attempts, in the order of run and epoch."""
    found = []
    for path in glob_paths(spark, f"{out_path}/{_MANIFEST}/*"):
        run, _, epoch = path.rsplit("/", 1)[1].rpartition(".")
        if run:
            found.append((run, int(epoch), read_small_text(spark, path)))
    return [f"{out_path}/run={r}/epoch={e}/attempt={a}" for r, e, a in sorted(found)]


def read_committed(spark: SparkSession, out_path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """Rows of all committed epochs with their ``run`` and ``epoch``; None if there are none (and no schema)."""
    paths = committed_paths(spark, out_path)
    if not paths:
        return spark.createDataFrame([], schema) if schema is not None else None
    reader = spark.read.option("basePath", out_path)
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths).drop("attempt")


def write_epoch(batch: DataFrame, out_path: str, run: str, epoch: int) -> bool:
    """Write and commit one micro-batch; False if the epoch was committed before (nothing is written then)."""
    spark = batch.sparkSession
    if is_committed(spark, out_path, run, epoch):
        return False
    attempt = uuid.uuid4().hex
    batch.write.parquet(f"{out_path}/run={run}/epoch={epoch}/attempt={attempt}")
    return commit(spark, out_path, run, epoch, attempt)
