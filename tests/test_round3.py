"""Filters before shuffles, encoding and packing by blocks, strict groups, one-pass mixtures, pruned reads."""

import random

import pytest
from pyspark.sql import functions as F

from kiln.functions import code, report
from kiln.functions import tokens as T
from kiln.operators import bloom, curate, decontam, grading, groups, mixture, tokenize
from kiln.sources import io

from .conftest import one_col


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, n=400):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    return [(i if i % 7 else None, " ".join(rng.choices(words, k=rng.randrange(0, 60))), "s" if i % 3 else None) for i in range(n)]


# -- Bloom filter -----------------------------------------------------------
def test_bloom_filter_has_all_members_and_few_others(spark):
    members = spark.range(3000).select(F.xxhash64("id").alias("h")).checkpoint()
    f = bloom.BloomFilter(members, "h")
    assert f.maybe_in(members, "h").count() == 3000
    others = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("h"), "id")
    assert f.maybe_in(others, "h").count() < 500 and f.maybe_in(others, "h").columns == ["h", "id"]
    full = bloom.BloomFilter(spark.range(50_000).select(F.xxhash64("id").alias("h")).checkpoint(), "h", max_blocks=1)
    assert full.table.count() == 1 and full.maybe_in(members, "h").count() == 3000
    assert bloom.BloomFilter(members.limit(0), "h").maybe_in(others, "h").count() == 0


def test_flags_above_the_bound_equal_those_below_and_little_is_shuffled(spark):
    rows = documents(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bench = spark.createDataFrame([(rows[i][1],) for i in (5, 6, 7, 14, 21)], "text string")
    sets = {"bench": (bench, "text")}
    want = [len(t.split()) >= 8 and any(
        set(zip(*[t.split()[k:] for k in range(8)])) & set(zip(*[b["text"].split()[k:] for k in range(8)])) for b in bench.collect()
    ) for _, t, _ in rows]
    for bound in (0, 10_000_000):
        got = decontam.decontaminate(docs, sets, "doc_id", "text", 8, max_broadcast_rows=bound).collect()
        assert [r["contaminated_bench"] for r in sorted(got, key=lambda r: rows.index((r["doc_id"], r["text"], r["source"])))] == want
    assert any(w and i is None for w, (i, _, _) in zip(want, rows))  # null ids are judged by their text
    members = decontam._gram_hashes(bench.select(F.split("text", " ").alias("_w")), 8).distinct().checkpoint()
    grams = decontam._gram_hashes(docs.select(F.split("text", " ").alias("_w")), 8)
    passed = bloom.BloomFilter(members, "_h").maybe_in(grams, "_h").count()
    true = grams.join(members, "_h", "left_semi").count()
    assert passed - true < 0.01 * grams.count()


def test_exact_dedup_keeps_one_row_per_text(spark):
    rows = [(3, "A b"), (1, "a  B"), (None, "a b"), (None, "x"), (None, " X"), (7, "y"), (7, "y"), (8, "z"), (9, None), (10, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((str(r["id"]), (r["text"] or "").strip().lower()) for r in decontam.exact_dedup(df, "id", "text").collect())
    assert got == [("1", "a  b"), ("10", ""), ("7", "y"), ("8", "z"), ("9", ""), ("None", "x")]


# -- Tokenizer and packing --------------------------------------------------
@pytest.mark.parametrize("bound", [None, 0])
def test_ids_by_block_equal_plain_ones(spark, bound):
    rows = documents(spark) + [(None, None, "s"), (1, "", None), (1, "w1 w2\x1cw3", None), (2, "the " * 500, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out, vocab = tokenize.whitespace_vocabulary_ids(df, "doc_id", "text", max_broadcast_rows=bound)
    number = {r["word"]: r["token_id"] for r in vocab.collect()}
    assert [number[w] for w in sorted(number)] == list(range(len(number)))
    got = sorted((str(r["doc_id"]), str(r["text"]), r["input_ids"]) for r in out.collect())
    assert got == sorted((str(i), str(t), [number[w] for w in (t or "").split()]) for i, t, _ in rows)
    assert out.columns == ["doc_id", "text", "source", "input_ids"]


def test_blocks_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string").coalesce(1)
    sizes = tokenize.with_blocks(df, "text", block_bytes=350).groupBy("_block").count().collect()
    assert max(r["count"] for r in sizes) == 3 and sum(r["count"] for r in sizes) == 50


def test_packing_keeps_null_shards_and_has_no_row_per_token(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), i, [rng.randrange(99) for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(60)] + [(None, 99, None)]
    df = spark.createDataFrame(rows, "shard string, doc_id long, input_ids array<int>")
    packed = tokenize.pack_blocks(df, "shard", "doc_id", max_length=16)
    got = {(r["shard"], r["block"]): r["input_ids"] for r in packed.collect()}
    want = {}
    for shard in ("a", None):
        flat = [x for s, _, ids in rows if s == shard for x in ids or []]
        want |= {(shard, k): flat[16 * k : 16 * k + 16] for k in range(-(-len(flat) // 16))}
    assert got == want
    assert "posexplode" not in plan(packed)


# -- Groups -----------------------------------------------------------------
def test_groups_of_the_wrong_size_raise(spark):
    df = spark.createDataFrame([(p, g, float(g)) for p in (1, 2, None) for g in range(4)] + [(2, 9, 1.0)], "p int, g int, r double")
    with pytest.raises(groups.GroupSizeError, match=r"1 groups do not hold 4 rows; {'p': 2} holds 5"):
        groups.collect_generations(df, "p", "g", ["r"], size=4)
    with pytest.raises(groups.GroupSizeError):
        groups.group_advantages(df, "r", "p", size=4)
    even = df.filter("g < 9")
    assert groups.collect_generations(even, "p", "g", ["r"], size=4).count() == 3
    assert groups.group_advantages(even, "r", "p", size=4).count() == 12


def test_long_groups_are_cut_into_ordered_runs(spark):
    rows = [("hot", i) for i in range(250)] + [(None, i) for i in range(30)] + [("small", 3), ("small", 1)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(6)
    got = {(r["k"], r["chunk"]): r["is"] for r in groups.collect_generations(df, "k", "i", ["i"], chunk=20).collect()}
    assert got[("small", 0)] == [1, 3] and got[(None, 1)] == list(range(20, 30))
    assert [x for c in range(13) for x in got[("hot", c)]] == list(range(250)) and max(map(len, got.values())) == 20


# -- Mixture ----------------------------------------------------------------
def test_mixture_reads_each_table_twice_and_takes_exact_shares(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        reads.add(1)
        return x

    base = spark.range(1000).withColumn("v", F.col("id") * 2).withColumn("s", F.col("id") % 2)
    def entry(name, k, weight):
        own = base.filter(F.col("s") == k)
        return mixture.MixtureEntry(name, own.withColumn("id", seen.asNondeterministic()("id")), "id", ["id", "v"], weight)

    spec = mixture.MixtureSpec([entry("a", 0, 0.33), entry("b", 1, 0.5), entry("none", 1, 0.0), entry("all", 0, None)], seed=4, test_split_size=0.1)
    parts = mixture.build_mixture(spec)
    rows = parts["train"].collect() + parts["test"].collect()
    count = {n: sum(r["mixture_entry"] == n for r in rows) for n in ("a", "b", "none", "all")}
    assert count == {"a": 165, "b": 250, "none": 0, "all": 500}
    assert sorted(r["position"] for r in rows) == list(range(1, 916)) and parts["test"].count() == 92
    assert reads.value <= 2 * 2000
    first = mixture.exact_fraction(base.filter("s = 0"), "id", 4, 0.33)
    assert {r["id"] for r in first.collect()} == {r["id"] for r in rows if r["mixture_entry"] == "a"}


# -- Padding ----------------------------------------------------------------
def test_rows_are_padded_to_their_batch(spark):
    rows = [(0, 1, [5, 6, 7], [-100, 6, 7], [0, 1, 1]), (0, 2, [8], [8], [1]), (None, 3, [], [], []), (None, 4, [1, 2], [1, 2], [0, 1]), (2, 5, None, None, None)]
    df = spark.createDataFrame(rows, "b int, i int, ids array<int>, labels array<int>, cm array<int>")
    got = {r["i"]: r for r in T.padded_batch(df, "b", "ids", "labels", ["cm"], pad_id=9, multiple=2).collect()}
    assert got[1]["ids"] == [5, 6, 7, 9] and got[1]["labels"] == [-100, 6, 7, -100] and got[1]["attention_mask"] == [1, 1, 1, 0]
    assert got[2]["ids"] == [8, 9, 9, 9] and got[2]["cm"] == [1, 0, 0, 0]
    assert got[3]["ids"] == [9, 9] and got[4]["attention_mask"] == [1, 1] and got[5]["ids"] == []


# -- Pruned reads -----------------------------------------------------------
def test_only_needed_folders_are_read(spark, tmp_path):
    tests, problems = str(tmp_path / "tests"), str(tmp_path / "problems")
    spark.range(2000).select("id", (F.col("id") % 50).alias("contest")).write.parquet(problems)
    io.write_partitioned(spark.range(2000).select("id", (F.col("id") % 50).alias("contest")), tests, "contest")
    wanted = spark.read.parquet(problems).filter("id IN (3, 53, 7)")
    got = io.read_needed_partitions(spark, tests, "contest", wanted)
    assert "dynamicpruning" in plan(got)
    for name in (tmp_path / "tests").glob("contest=[49]*/*.parquet"):
        name.with_name(f".{name.name}.crc").unlink(missing_ok=True)
        name.write_bytes(b"not a parquet file")  # a folder that is read would fail
    assert got.count() == 80 and {r["contest"] for r in got.select("contest").distinct().collect()} == {3, 7}


def test_json_arrays_and_request_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0), (3, "é", 1)], "id long, t string, b int")
    io.write_json_arrays(df, str(tmp_path / "a"), "b")
    back = io.read_json_array(spark, str(tmp_path / "a"), "id long, t string")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None), (3, "é")]
    curate.write_batch_requests(df, str(tmp_path / "r.jsonl"), max_per_file=1)
    assert io.read_any(spark, str(tmp_path / "r.jsonl"), df.schema).count() == 3


def test_preview(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "x" * 300)], "id long, response string")
    r = curate.dataset_preview(df, "id").first()
    assert (r["n_rows"], r["fields"]) == (3, ["id", "response"]) and r["first_row"] == '{"id":1,"response":"' + "x" * 200 + '..."}'
    empty = curate.dataset_preview(df.limit(0), "id").first()
    assert (empty["n_rows"], empty["first_row"]) == (0, None)


# -- Code patches, statuses, reports ---------------------------------------
@pytest.mark.parametrize(
    "text,want",
    [
        ("from fractions import gcd\nx", "\nfrom math import gcd"),
        ("from fractions import gcd,Fraction", "from fractions import Fraction"),
        ("from fractions import (gcd)\ny", "\ny"),
        ("from fractions import (Fraction,\n gcd)", "from fractions import (Fraction)"),
        ("from fractions import Fraction # gcd", "from fractions import Fraction # gcd"),
        ("from fractions import gcdx, Fraction", "from fractions import gcdx, Fraction"),
        ("import collections\nfrom collections import MutableSet, deque", "from collections.abc import MutableSet, deque"),
        ("print(os.getlogin())", "print(False)"),
        ("print(array.array('c', b''), inspect.getargspec)", "print(array.array('b', b''), inspect.getfullargspec)"),
        ("x = 1\\\\", "x = 1"),
    ],
)
def test_python_patch(spark, text, want):
    out = one_col(spark, [text]).select(code.patch_code("c", "python")).first()[0]
    assert want in out and not out.endswith("\\")


def test_early_stop_takes_the_first_failing_batch(spark):
    rows = [(1, 1, 1.0, "AC"), (1, 2, 0.0, "WA"), (1, 2, 0.0, "TLE"), (1, 3, 0.0, "CE"), (1, 4, 1.0, "AC"), (2, 1, 0.5, "PA"), (2, 2, 1.0, "AC"), (None, 1, 0.0, "RE")]
    df = spark.createDataFrame(rows, "k int, batch_no int, score double, status string")
    got = {r["k"]: (r["subtask_status"], r["n_tests"], r["n_skipped"], r["subtask_score"]) for r in grading.early_stopped_scores(df, ["k"]).collect()}
    assert got == {1: ("WA", 5, 2, 0.0), 2: ("PA", 2, 0, 0.5), None: ("RE", 1, 0, 0.0)}
    stopped = grading.subtask_scores(grading.apply_early_stop(df, ["k"]), ["k"])
    assert {r["k"]: r["subtask_status"] for r in stopped.collect()} == {1: "WA", 2: "PA", None: "RE"}


def test_report_lines_for_other_rewards(spark):
    text = "<think>\na\n</think>\n<answer>\n1\n</answer>"
    df = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, None), (4, -0.5)], "k int, o double")
    rep = report.evaluation_report(F.lit(text), F.lit("<answer>1</answer>"), F.col("k"), others={"extra": F.col("o")})
    got = {r["k"]: r["t"] for r in df.select("k", rep.alias("t")).collect()}
    assert "extra: reward=0.5" in got[2] and "extra: reward=None" in got[3]
    assert [got[k].endswith(report.PERFECT_SUMMARY) for k in (1, 2, 3, 4)] == [True, False, True, True]
