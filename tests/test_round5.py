"""Documents without words in the token queries."""

import math

import duckdb
import pytest

from kiln.functions import tokens
from kiln.plans import catalog
from kiln.plans.registry import REGISTRY

catalog.load()

LONG = " ".join(f"w{i % 23}" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string"
WORDLESS = [None, "", " \n\t ", "one"]


def documents(spark, top, texts):
    """A documents table with one row for each text."""
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{top}/documents.parquet")
    return str(top)


def by_sql(top, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{top}/documents.parquet/*.parquet'")
    return con.execute(REGISTRY[name].sql).fetchall()


# -- F1: a document without words has no next token ---------------------------
def test_shifted_hits_of_short_arrays(spark):
    rows = [([], []), ([], [1, 2]), ([1, 2], []), ([5], [5]), ([7, 8], [-100, 7]), ([7, 8, 9], [-100, -100, 8]), (None, None)]
    df = spark.createDataFrame(rows, "p array<int>, l array<int>").coalesce(1)
    correct, total = tokens.shifted_token_hits("p", "l")
    got = [tuple(r) for r in df.select(correct, total).collect()]
    assert got == [(0, 0), (0, 0), (0, 0), (0, 0), (1, 1), (1, 1), (None, None)]


def test_token_accuracy_with_documents_without_words(spark, tmp_path):
    top = documents(spark, tmp_path, [LONG, *WORDLESS, LONG + " end"])
    got = [tuple(r) for r in REGISTRY["token_accuracy"].fn(spark, top).collect()]
    assert got == by_sql(top, "token_accuracy") and got[0][1] == 24 + 25


@pytest.mark.parametrize("texts", [WORDLESS, ["a b c", "b"]])
def test_token_accuracy_without_any_label(spark, tmp_path, texts):
    top = documents(spark, tmp_path, texts)
    got, want = REGISTRY["token_accuracy"].fn(spark, top).collect(), by_sql(top, "token_accuracy")
    assert [tuple(r[:2]) for r in got] == [r[:2] for r in want] == [(0, 0)]
    assert math.isnan(got[0][2]) and math.isnan(want[0][2])
