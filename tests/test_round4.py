"""Tables that are folders, copied corpora, token queries and readers of bounded memory."""

import pytest
from pyspark.sql import functions as F

from kiln.functions import hooks, text
from kiln.operators import decontam, tokenize
from kiln.plans import catalog
from kiln.plans.registry import REGISTRY

from .conftest import SF_SMALL

catalog.load()


def tables_in_folders(spark, top, n=60):
    """The documents and events of sf0.001, each a folder of several parquet files."""
    for name in ("documents", "events"):
        rows = spark.read.parquet(f"{SF_SMALL}/{name}.parquet").limit(n)
        rows.repartition(3).write.parquet(f"{top}/{name}.parquet")
    return str(top)


# -- F1, F2: streams over tables that are folders ----------------------------
@pytest.mark.parametrize("name", ["stream_reward_scoring", "stream_resume_after_crash"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    got = REGISTRY[name].fn(spark, tables_in_folders(spark, tmp_path))
    ids = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id")
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in ids.collect())


def test_window_stream_reads_a_folder_of_events(spark, tmp_path):
    got = REGISTRY["stream_window_means"].fn(spark, tables_in_folders(spark, tmp_path))
    assert got.agg(F.sum("n")).first()[0] == 60


# -- F3, F4, F5: only what passes the filter is shuffled ---------------------
def test_the_filter_is_probed_before_the_shuffle(spark):
    """Spark once moved the semi-join with the members below the Bloom filter's join."""
    members = spark.range(50).select(F.xxhash64("id").alias("_h")).checkpoint()
    grams = spark.range(5000).select(F.xxhash64("id").alias("_h"), "id")
    got = decontam.probe_hashes(grams, members, max_broadcast_rows=0)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) >= 2 and "_block" not in joins[0]  # the outermost join is the one with the members
    assert sorted(r["id"] for r in got.collect()) == list(range(50)) and got.columns == grams.columns


def test_only_shared_grams_become_strings(spark):
    docs = spark.createDataFrame([(1, "A b c d e"), (2, "x b C  d y"), (2, None), (None, "q r s t")], "id long, text string")
    one = spark.createDataFrame([("b c d",), ("r s",)], "text string")
    two = spark.createDataFrame([("z q r s",)], "text string")
    sets = {"one": (one, "text"), "two": (two, "text")}
    for bound in (0, 1000):
        got = decontam.decontaminate(docs, sets, "id", "text", 3, max_broadcast_rows=bound)
        flags = {(r["id"], r["text"]): (r["contaminated_one"], r["contaminated_two"]) for r in got.collect()}
        assert flags == {(1, "A b c d e"): (True, False), (2, "x b C  d y"): (True, False), (2, None): (False, False), (None, "q r s t"): (False, True)}


# -- F6, F8, F9, F10: texts become numbers once ------------------------------
def test_without_the_text_only_numbers_are_kept(spark):
    rows = [(1, "b a  b", "s"), (1, None, None), (None, "", "s"), (None, "c\na", "t"), (2, "a", "s")]
    df = spark.createDataFrame(rows, "id long, text string, source string").repartition(2)
    out, vocab = tokenize.whitespace_vocabulary_ids(df, "id", "text", keep=["source", "id"])
    assert out.columns == ["source", "id", "input_ids"] and "text" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((str(r["source"]), str(r["id"]), r["input_ids"]) for r in out.collect())
    assert got == [("None", "1", []), ("s", "1", [1, 0, 1]), ("s", "2", [0]), ("s", "None", []), ("t", "None", [2, 0])]


def test_blocks_of_numbers_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i, f"x{i} y" + " " * 96) for i in range(50)], "id long, text string").coalesce(1)
    rows = tokenize.encoded_blocks(df, "text", ["id"], block_bytes=350)
    words = {r["_block"]: r["_words"] for r in rows.filter("_words IS NOT NULL").collect()}
    texts = [(r["id"], [words[r["_block"]][k] for k in r["_local"]]) for r in rows.filter("_words IS NULL").collect()]
    assert sorted(texts) == [(i, [f"x{i}", "y"]) for i in range(50)] and max(map(len, words.values())) == 4


# -- F7: a reward function gets few rows at once -----------------------------
def test_a_python_reward_is_called_on_slices(spark):
    wide = hooks.python_reward(lambda c, s: c.str.len() + 1000.0 * len(c) + 0.0 * c.index.max(), rows=7)
    df = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("c"), "id")
    got = [r[0] for r in df.select(wide("c")).collect()]
    assert got == [i + (7000.0 if i < 98 else 2000.0) for i in range(100)]


# -- F11: n-grams -------------------------------------------------------------
def test_ngrams_by_name_equal_those_by_expression_without_slices(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b"],), ([],), (None,)], "w array<string>")
    for n in (1, 2, 3, 4):
        named = text.word_ngrams("w", n)
        got = df.select(named.alias("x"), text.word_ngrams(F.col("w"), n).alias("y")).collect()
        assert all(r["x"] == r["y"] for r in got)
        assert got[0]["x"] == [" ".join("abcd"[i : i + n]) for i in range(5 - n)]
    assert "array_join" not in str(text.word_ngrams("w", 3))
