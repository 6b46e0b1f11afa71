"""The pipeline's stages chained, and the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from kiln.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append((name, {r["doc_id"] for r in out.select("doc_id").collect()}))
        if name != P.STAGES[-1][0]:
            assert tuple(out.columns) == P.COLUMNS
        docs = out
    for (_, a), (_, b) in zip(seen, seen[1:]):
        assert b <= a
    assert len(seen[0][1]) > 50 and seen[-1][1] == seen[-2][1]


@pytest.mark.parametrize("name", ["op5_quality_rules", "op8_chat_format", "op9_line_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    rows = E.queries()[name](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, cur.fetchall()))


def test_chat_query_judges_the_order_of_roles(spark, tmp_path):
    """The registered query over conversations out of order: its verdicts are those of its SQL and of a plain walk."""
    roles = [
        ["user", "assistant"], ["system", "user", "assistant"], ["assistant", "user"], ["user", "user", "assistant"],
        ["user", "assistant", "user"], ["system"], ["user", None, "assistant"], ["system", "assistant"], ["other", "assistant"],
    ]
    rows = [(c, t if t else None, r, f"text {t}") for c, rs in enumerate(roles) for t, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(E.oracle_sql()["op8_chat_format"])
    cols = [d[0] for d in cur.description]
    got = E.queries()["op8_chat_format"](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))
    steps = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    for r in got:
        if r["conv_id"] >= 0:
            walk = ["start", *[x or "" for x in roles[r["conv_id"]]]]
            bad = next((i for i, s in enumerate(zip(walk, walk[1:])) if s not in steps), None)
            bad = len(walk) - 1 if bad is None and walk[-1] != "assistant" else bad
            assert (r["valid"], r["first_bad_turn"]) == (bad is None, bad)


def test_pipeline_encodes_and_decodes_in_two_stages(spark):
    """One Python worker a task: the ids are written before they are decoded."""
    docs = spark.createDataFrame([(1, "s", "two words"), (2, None, None)], "doc_id long, source string, text string")
    out = P.tokenize(spark, docs, SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r["doc_id"], r["n_tokens"] > 0) for r in out.orderBy("doc_id").collect()] == [(1, True), (2, False)]
