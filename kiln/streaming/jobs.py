"""Structured Streaming versions of the incremental patterns (ST1–ST3, SNK5).

* ST1 / SNK5 — score completions as files arrive and append each micro-batch
  to a parquet table (``foreachBatch``), instead of flushing every N rows.
* ST2 — resume without redoing finished rows: the stream's checkpoint skips
  files already processed, an epoch counts once it is in the manifest of
  committed epochs (``commits.py``; a replayed batch neither loses nor doubles
  rows), ids finished by committed epochs are anti-joined away on ``md5(id)``,
  and ids that repeat within a stream are dropped by a keyed state that expires
  with the watermark.
* ST3 — per-step metric means as event-time tumbling windows with a
  watermark: in update mode each batch upserts the windows it changed; in
  append mode a window is written once, when the watermark passes its end and
  its state is evicted, and rows too late for their window go to a side table.

Every function has a batch twin built from the same column functions, so the
streaming result can be compared with a plain DataFrame (and SQL) result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..session import checkpoint_dir
from ..sources.tables import table_path
from .commits import read_committed, write_epoch

Batch = Callable[[DataFrame, int], None]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """File stream of one named table, be it a single parquet file or a folder of them."""
    # A pattern that only the table's own name fits: Spark lists a file and a folder alike then.
    # Without one, a path must be a folder.
    return file_stream(spark, table_path(sf_dir, f"[{name[0]}]{name[1:]}"), schema)


def run_id(batch: DataFrame, otherwise: str) -> str:
    """Id of the streaming query a micro-batch belongs to (its checkpoint keeps it)."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or otherwise


def append_new_rows(out_path: str, key: str, done_keys: DataFrame | None = None) -> Batch:
    """foreachBatch writer (ST1 / ST2): each micro-batch is one committed epoch.

    A replayed batch whose epoch is committed writes nothing; one whose epoch is
    not writes it anew, whatever an attempt that died has left. Rows whose
    ``md5(key)`` is in ``done_keys`` (ids of epochs that were committed when the
    stream started) are skipped; a null key is a key like any other.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        fresh = batch
        if done_keys is not None:
            done = done_keys.select(F.col("_k").alias("_done"))
            fresh = fresh.join(done, _key_hash(key).eqNullSafe(F.col("_done")), "left_anti")
        write_epoch(fresh, out_path, run_id(batch, without_query), epoch_id)

    without_query = uuid.uuid4().hex
    return write


def _key_hash(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def finished_keys(spark: SparkSession, out_path: str, key: str) -> DataFrame | None:
    """Distinct ``md5(key)`` of the rows of committed epochs (None if there are none yet)."""
    done = read_committed(spark, out_path)
    return None if done is None else done.select(_key_hash(key).alias("_k")).distinct()


def run_to_end(stream: DataFrame, write: Batch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All input that is there, in micro-batches through ``write``; returns the ended query."""
    q = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def run_scoring_stream(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    key: str,
    out_path: str,
    checkpoint: str,
    done_keys: DataFrame | None = None,
) -> None:
    """ST1 + ST2: apply ``score`` to each micro-batch and write it; runs to the end of input.

    The checkpoint makes a restarted stream skip files already committed;
    ``done_keys`` additionally skips ids finished by other runs.
    """
    run_to_end(score(stream), append_new_rows(out_path, key, done_keys), checkpoint)


def first_arrivals(stream: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """ST2: rows whose ``key`` has not been seen in the stream, also before a restart.

    The keys seen are Spark's keyed state in the checkpoint. A key expires once
    the watermark (latest event time less ``within``) passes the event time of its
    first row plus ``within``, so the state holds a bounded span of event time and
    repeats up to ``within`` apart are dropped. Which of the rows of one batch that
    share a key stays is left to Spark.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def windowed_means(df: DataFrame, ts: str, group: str, value: str, window: str = "1 hour") -> DataFrame:
    """ST3 batch/stream body: count and mean of ``value`` per tumbling window and group."""
    return df.groupBy(F.window(ts, window).alias("w"), F.col(group)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def upsert_windows(out_path: str) -> Batch:
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch_id).cast("long")).write.mode("append").parquet(out_path)

    return write


def run_window_stream(
    stream: DataFrame, ts: str, group: str, value: str, out_path: str, checkpoint: str,
    window: str = "1 hour", watermark: str = "10 minutes",
) -> None:
    """ST3: watermark + tumbling windows, update mode, each batch's changed windows appended.

    Event time must be a ``TIMESTAMP``; a ``TIMESTAMP_NTZ`` column is read as
    wall-clock time in the session time zone.
    """
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    agg = windowed_means(stream.withWatermark(ts, watermark), ts, group, value, window)
    run_to_end(agg, upsert_windows(out_path), checkpoint, "update")


def read_latest_windows(spark: SparkSession, out_path: str, group: str) -> DataFrame:
    """Latest version of each (window, group) written by :func:`run_window_stream`."""
    raw = spark.read.parquet(out_path)
    latest = raw.groupBy("w", group).agg(F.max_by(F.struct("n", "total"), "_epoch").alias("_v"))
    return latest.select("w", group, F.col("_v.n").alias("n"), F.col("_v.total").alias("total"))


def run_closing_windows(
    stream: DataFrame, ts: str, group: str, value: str, out_path: str, checkpoint: str,
    window: str = "1 hour", watermark: str = "10 minutes",
) -> StreamingQuery:
    """ST3: tumbling windows in append mode; each window is one row of ``out_path``, for good.

    A window is written by the batch in which the watermark passes its end, and
    its state is evicted then; rows of a window that was closed before their batch
    are dropped by Spark (:func:`run_late_rows` keeps them).
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)

    def write(batch: DataFrame, epoch_id: int) -> None:
        write_epoch(batch, out_path, run_id(batch, "windows"), epoch_id)

    return run_to_end(windowed_means(timed, ts, group, value, window), write, checkpoint)


def run_late_rows(
    stream: DataFrame, ts: str, out_path: str, checkpoint: str, window: str = "1 hour", watermark: str = "10 minutes"
) -> StreamingQuery:
    """ST3 side table: every row that comes after its window was closed, with the watermark that closed it.

    The watermark is the latest event time of all earlier micro-batches less the
    delay, as Spark defines it; the latest times are kept as a table of committed
    epochs beside the rows, so a restart goes on from them. It must see the same
    arrivals as the stream of windows (one micro-batch for each arrival).
    """
    delay = F.expr(f"INTERVAL {watermark}")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark, run = batch.sparkSession, run_id(batch, "late")
        seen = read_committed(spark, f"{out_path}/latest", "run string, epoch long, latest timestamp")
        before = seen.filter((F.col("run") == run) & (F.col("epoch") < epoch_id)).agg(F.max("latest")).first()[0]
        if before is not None:
            closed = F.lit(before) - delay
            late = batch.filter(F.window(F.col(ts), window)["end"] <= closed).withColumn("watermark", closed)
        else:
            late = batch.filter(F.lit(False)).withColumn("watermark", F.lit(None).cast("timestamp"))
        write_epoch(late, f"{out_path}/rows", run, epoch_id)
        write_epoch(batch.agg(F.max(ts).alias("latest")), f"{out_path}/latest", run, epoch_id)

    return run_to_end(timed, write, checkpoint)
