"""Streaming jobs run to completion over the test tables (ST1–ST3, SNK5)."""

from __future__ import annotations

import os

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewards as R
from ..sources.fixtures import rollouts_from
from ..sources.tables import read_table
from ..streaming import commits as SC
from ..streaming import jobs as SJ
from . import sqltext as S
from .registry import query

DEC = 6


def _score(docs: DataFrame) -> DataFrame:
    r = rollouts_from(docs)
    return r.select(
        "doc_id",
        "prompt_id",
        R.accuracy_reward("completion", "solution").alias("accuracy"),
        R.format_reward("completion").alias("format"),
        R.tag_count_reward("completion").alias("tag_count"),
    )


_STREAM_SCORE_SQL = f"""
WITH {S.ROLLOUTS.strip()}
SELECT doc_id, prompt_id, {S.accuracy('completion', 'solution')} AS accuracy, {S.fmt('completion')} AS format,
       {S.tag_count('completion')} AS tag_count
FROM rollouts
"""


@query("stream_reward_scoring", ids=("ST1", "ST2", "SNK5"), sql=_STREAM_SCORE_SQL)
def q_stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as a file stream → rollouts → rewards → written per batch; run twice.

    The second run reuses the checkpoint and skips finished ids: nothing is written twice.
    """
    schema = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).schema
    out = SJ.scratch_dir(spark, "scored")
    ckpt = SJ.scratch_dir(spark, "scored-ckpt")
    for _ in range(2):
        stream = SJ.table_stream(spark, sf_dir, "documents", schema)
        SJ.run_scoring_stream(stream, _score, "doc_id", out, ckpt, SJ.finished_keys(spark, out, "doc_id"))
    return SC.read_committed(spark, out).select("doc_id", "prompt_id", "accuracy", "format", "tag_count")


class _Killed(RuntimeError):
    """Stands for the end of a driver."""


@query("stream_resume_after_crash", ids=("ST2", "SNK5"), sql=_STREAM_SCORE_SQL)
def q_stream_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring stream dies twice in one micro-batch and goes on from its checkpoint: every row once.

    First between the batch's files and their commit, then between the commit and
    Spark's own log of it; finished ids are read anew at each start.
    """
    schema = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).schema
    out = SJ.scratch_dir(spark, "crashed")
    ckpt = SJ.scratch_dir(spark, "crashed-ckpt")

    def before_commit(batch: DataFrame, epoch: int) -> None:
        batch.write.parquet(f"{out}/run={SJ.run_id(batch, '')}/epoch={epoch}/attempt=dead")
        raise _Killed("before the commit")

    def after_commit(batch: DataFrame, epoch: int) -> None:
        SJ.append_new_rows(out, "doc_id", SJ.finished_keys(spark, out, "doc_id"))(batch, epoch)
        raise _Killed("after the commit")

    for write in (before_commit, after_commit, None):
        stream = _score(SJ.table_stream(spark, sf_dir, "documents", schema))
        try:
            SJ.run_to_end(stream, write or SJ.append_new_rows(out, "doc_id", SJ.finished_keys(spark, out, "doc_id")), ckpt)
        except StreamingQueryException as e:
            if _Killed.__name__ not in str(e):
                raise
    return SC.read_committed(spark, out).select("doc_id", "prompt_id", "accuracy", "format", "tag_count")


def _third() -> Column:
    day = F.dayofmonth("ts")
    return F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)


def _arrive(spark: SparkSession, parts: list[DataFrame], run) -> None:
    """Each part comes as files of one folder, then ``run(stream)`` reads on to the end of what is there."""
    folder = SJ.scratch_dir(spark, "arrivals")
    for part in parts:
        part.write.mode("append").parquet(folder)
        run(SJ.file_stream(spark, folder, parts[0].schema))


@query("stream_first_arrivals", ids=("ST2",), sql="SELECT event_id, event_type, value FROM events")
def q_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three arrivals with repeats, the stream started anew for each: every event once.

    An arrival repeats a quarter of its own events and the last day of the one before.
    """
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"]).withColumn("third", _third())
    own = [e.filter(F.col("third") == k) for k in range(3)]
    again = [p.filter(F.col("event_id") % 4 == 0) for p in own]
    last_day = [p.filter(F.dayofmonth("ts") % 10 == 0) for p in own]
    parts = [own[0].unionByName(again[0])]
    parts += [own[k].unionByName(again[k]).unionByName(last_day[k - 1]) for k in (1, 2)]
    out, ckpt = SJ.scratch_dir(spark, "first"), SJ.scratch_dir(spark, "first-ckpt")

    def write(batch: DataFrame, epoch: int) -> None:
        SC.write_epoch(batch, out, SJ.run_id(batch, "first"), epoch)

    _arrive(spark, parts, lambda stream: SJ.run_to_end(SJ.first_arrivals(stream, "event_id", "ts", "3 days"), write, ckpt))
    return SC.read_committed(spark, out).select("event_id", "event_type", "value")


_WINDOW_SQL = f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
       round(avg(value), {DEC}) AS mean_value
FROM events GROUP BY date_trunc('hour', ts), event_type
"""


@query("stream_window_means", ids=("ST3",), sql=_WINDOW_SQL)
def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream → 10-minute watermark → hourly mean value per event type (update mode, upserted)."""
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("ts", "event_type", "value").schema
    out = SJ.scratch_dir(spark, "windows")
    ckpt = SJ.scratch_dir(spark, "windows-ckpt")
    stream = SJ.table_stream(spark, sf_dir, "events", schema)
    SJ.run_window_stream(stream, "ts", "event_type", "value", out, ckpt)
    w = SJ.read_latest_windows(spark, out, "event_type")
    return w.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type",
        "n",
        F.round(F.col("total") / F.col("n"), DEC).alias("mean_value"),
    )


@query("window_means_batch", ids=("ST3",), sql=_WINDOW_SQL)
def q_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the streaming window job (same aggregation function)."""
    e = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    w = SJ.windowed_means(e, "ts", "event_type", "value")
    return w.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type",
        "n",
        F.round(F.col("total") / F.col("n"), DEC).alias("mean_value"),
    )


# Arrivals out of order: an event comes with its third of the month, each seventh event one arrival later.
_ARRIVALS_SQL = """
a AS (SELECT event_id, ts, event_type, value, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END
        + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS arrival, date_trunc('hour', ts) AS ws FROM events),
m AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival) - INTERVAL 2 HOUR AS wm FROM a GROUP BY arrival),
r AS (SELECT a.*, coalesce(ws + INTERVAL 1 HOUR <= m.wm, false) AS late FROM a LEFT JOIN m ON m.arrival = a.arrival - 1)"""


def _disordered(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    at = _third() + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return [e.filter(at == k) for k in range(4)]


@query(
    "stream_windows_closed",
    ids=("ST3",),
    sql=f"""WITH {_ARRIVALS_SQL.strip()}
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(avg(value), {DEC}) AS mean_value
FROM r WHERE NOT late AND ws + INTERVAL 1 HOUR <= (SELECT max(wm) FROM m) GROUP BY ws, event_type""",
)
def q_windows_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means in append mode over four arrivals out of order: each window once, when it is closed, late rows left out."""
    out, ckpt = SJ.scratch_dir(spark, "closed"), SJ.scratch_dir(spark, "closed-ckpt")
    _arrive(
        spark,
        _disordered(spark, sf_dir),
        lambda stream: SJ.run_closing_windows(stream, "ts", "event_type", "value", out, ckpt, "1 hour", "2 hours"),
    )
    return SC.read_committed(spark, out).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type",
        "n",
        F.round(F.col("total") / F.col("n"), DEC).alias("mean_value"),
    )


@query(
    "stream_late_rows",
    ids=("ST3",),
    sql=f"""WITH {_ARRIVALS_SQL.strip()}
SELECT event_id, event_type, value, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start FROM r WHERE late""",
)
def q_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the same arrivals that came after their window was closed."""
    out, ckpt = SJ.scratch_dir(spark, "late"), SJ.scratch_dir(spark, "late-ckpt")
    _arrive(spark, _disordered(spark, sf_dir), lambda stream: SJ.run_late_rows(stream, "ts", out, ckpt, "1 hour", "2 hours"))
    start = F.date_format(F.window("ts", "1 hour")["start"], "yyyy-MM-dd HH:mm:ss")
    return SC.read_committed(spark, f"{out}/rows").select("event_id", "event_type", "value", start.alias("window_start"))
