"""Streams that are killed, repeat themselves or come late."""

import pytest
from pyspark.sql import functions as F

from kiln.streaming import commits, jobs


class Killed(RuntimeError):
    pass


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def rows(spark, low, high):
    return spark.range(low, high).withColumn("text", F.lit("t"))


def test_an_epoch_written_twice_keeps_its_rows(spark, tmp_path):
    """The writer called twice for one epoch, finished keys read in between (as a restart does)."""
    out = str(tmp_path / "out")
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "q1")
    try:
        jobs.append_new_rows(out, "id", jobs.finished_keys(spark, out, "id"))(rows(spark, 0, 20), 0)
        again = jobs.append_new_rows(out, "id", jobs.finished_keys(spark, out, "id"))
        again(rows(spark, 0, 20), 0)
        assert ids(commits.read_committed(spark, out)) == list(range(20))
        again(rows(spark, 10, 30), 1)  # ids of committed epochs are not written again
        assert ids(commits.read_committed(spark, out)) == list(range(30))
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)


def test_an_attempt_without_commit_is_not_read_and_not_finished(spark, tmp_path):
    out = str(tmp_path / "out")
    rows(spark, 0, 5).write.parquet(f"{out}/run=q/epoch=0/attempt=dead")
    assert commits.read_committed(spark, out) is None and jobs.finished_keys(spark, out, "id") is None
    assert commits.write_epoch(rows(spark, 0, 5), out, "q", 0)
    assert not commits.write_epoch(rows(spark, 0, 5), out, "q", 0)
    assert ids(commits.read_committed(spark, out)) == list(range(5))
    # two attempts at once: the first rename counts, the other's rows are never read
    assert commits.commit(spark, out, "q", 1, "a") and not commits.commit(spark, out, "q", 1, "b")


def test_null_keys_are_finished_once(spark, tmp_path):
    out = str(tmp_path / "out")
    some = spark.createDataFrame([(None, "a"), (1, "b")], "id long, text string")
    commits.write_epoch(some, out, "q", 0)
    write = jobs.append_new_rows(out, "id", jobs.finished_keys(spark, out, "id"))
    write(spark.createDataFrame([(None, "c"), (2, "d")], "id long, text string"), 0)
    assert sorted(r["text"] for r in commits.read_committed(spark, out).collect()) == ["a", "b", "d"]


@pytest.mark.parametrize("when", ["before", "after"])
def test_killed_stream_goes_on_without_loss(spark, tmp_path, when):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows(spark, 0, 40).write.parquet(folder)
    schema = rows(spark, 0, 1).schema

    def dies(batch, epoch):
        if when == "before":
            batch.write.parquet(f"{out}/run={jobs.run_id(batch, '')}/epoch={epoch}/attempt=dead")
        else:
            jobs.append_new_rows(out, "id")(batch, epoch)
        raise Killed

    with pytest.raises(Exception, match="Killed"):
        jobs.run_to_end(jobs.file_stream(spark, folder, schema), dies, ckpt)
    rows(spark, 40, 60).write.mode("append").parquet(folder)
    for _ in range(2):
        done = jobs.finished_keys(spark, out, "id")
        jobs.run_to_end(jobs.file_stream(spark, folder, schema), jobs.append_new_rows(out, "id", done), ckpt)
    assert ids(commits.read_committed(spark, out)) == list(range(60))


def test_repeats_within_the_span_are_dropped_and_state_expires(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "id long, ts timestamp"

    def at(*pairs):
        return spark.createDataFrame([(i, f"2024-01-{d:02d} 00:00:00") for i, d in pairs], "id long, ts string").select(
            "id", F.col("ts").cast("timestamp").alias("ts")
        )

    def write(batch, epoch):
        commits.write_epoch(batch, out, jobs.run_id(batch, "x"), epoch)

    last = None
    for part in (at((1, 1), (1, 1), (2, 1)), at((1, 2), (3, 2)), at((2, 3), (4, 20)), at((4, 20), (1, 21))):
        part.write.mode("append").parquet(folder)
        stream = jobs.first_arrivals(spark.readStream.schema(schema).parquet(folder), "id", "ts", "5 days")
        last = jobs.run_to_end(stream, write, ckpt)
    # 1 comes again after its span: it is new
    assert ids(commits.read_committed(spark, out)) == [1, 1, 2, 3, 4]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in last.recentProgress if p["stateOperators"]]
    assert held and held[-1] == 2  # keys 1 to 3 of the first days are evicted


def test_closed_windows_and_late_rows_add_up(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts = [[(h, m) for h in range(0, 5) for m in (5, 35)], [(2, 50), (4, 20), (9, 0)], [(3, 10), (8, 30), (8, 59), (14, 0)]]
    names = ("closed", "closed-ckpt", "late", "late-ckpt")
    closed, closed_ckpt, late, late_ckpt = (str(tmp_path / n) for n in names)
    everything = []
    for part in parts:
        made = [(f"2024-01-01 {h:02d}:{m:02d}:00", "k", float(m)) for h, m in part]
        everything += made
        df = spark.createDataFrame(made, "ts string, g string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(folder)
        stream = spark.readStream.schema("ts timestamp, g string, v double").parquet(folder)
        q = jobs.run_closing_windows(stream, "ts", "g", "v", closed, closed_ckpt, "1 hour", "30 minutes")
        jobs.run_late_rows(stream, "ts", late, late_ckpt, "1 hour", "30 minutes")
    got = {r["w"]["start"].hour: (r["n"], r["total"]) for r in commits.read_committed(spark, closed).collect()}
    gone = {(r["ts"].hour, r["ts"].minute) for r in commits.read_committed(spark, f"{late}/rows").collect()}
    assert gone == {(2, 50), (3, 10)}
    want = {}
    for ts, _, v in everything:
        h, m = int(ts[11:13]), int(ts[14:16])
        if (h, m) not in gone and h + 1 <= 13:
            n, total = want.get(h, (0, 0.0))
            want[h] = (n + 1, total + v)
    assert got == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held and held[-1] == 1  # only the window that is still open
