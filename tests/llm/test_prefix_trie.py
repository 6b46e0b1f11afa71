"""The prefix trie against plain dictionaries, and the double array by itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, id int, ids string, cut int, _key int, size int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", 2, 3, 4) for r in rows], SCHEMA)


def sequences(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        if c is not None:
            out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seqs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture(seed=1, n=400):
    rng, rows = random.Random(seed), []
    shared = [("user", f"common {i}") for i in range(9)]
    for c in range(n):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é漢", None, ""])) for _ in range(rng.randrange(1, 7))]
        if c % 3 == 0:
            turns = shared[: rng.randrange(4, 10)] + turns
        if c % 3 == 1:
            turns = [("user", "copy"), ("assistant", "copy")]
        rows += [(c * 7 - 60, i, *t) for i, t in enumerate(turns)]
    rows += [(9001, i, "user", f"long {i % 50}") for i in range(700)]
    rows += [(9002, None, "user", "no turn"), (9002, 0, "user", "b"), (9002, 0, "user", "a"), (9002, 0, "user", "a"), (None, 0, "user", "nobody")]
    return rows


@pytest.mark.parametrize("least,shard", [(256, 200_000), (4, 200_000), (4, 30)])
def test_nodes_equal_plain_dictionaries(spark, monkeypatch, least, shard):
    """Also where common beginnings are split, over several depths, and shards are small."""
    monkeypatch.setattr(T, "LEAST_SPLIT", least)
    monkeypatch.setattr(T, "SHARD_TURNS", shard)
    rows = fixture()
    seqs = T.turn_sequences(table(spark, rows))
    for build, plain in ((lambda s: s, lambda s: s), (T.rebuilt, rebuilt)):
        got = sorted(map(tuple, T.trie_nodes(build(seqs)).collect()), key=str)
        assert got == brute(plain(sequences(rows)))
    if shard == 30:
        cuts = {r["cut"] for r in T.with_shards(T.distinct_sequences(seqs)).select("cut").distinct().collect()}
        assert len(cuts) > 2


def test_many_equal_conversations_and_turnless_ones(spark):
    rows = [(c, 0, "user", "same") for c in range(9000)] + [(20001, i, "user", f"t{i}") for i in range(3)]
    assert sorted(map(tuple, T.trie_nodes(T.rebuilt(T.turn_sequences(table(spark, rows)))).collect()), key=str) == brute(rebuilt(sequences(rows)))
    # 20001 has no base: its first h turns are gone, maybe all of them
    alone = [(c, 0, "user", "x") for c in range(20001, 20005)]
    assert sorted(map(tuple, T.trie_nodes(T.rebuilt(T.turn_sequences(table(spark, alone)))).collect()), key=str) == brute(rebuilt(sequences(alone)))


def test_empty_table(spark):
    assert T.trie_nodes(T.turn_sequences(table(spark, []))).collect() == []


def test_double_array_holds_exactly_its_sequences():
    rng = np.random.default_rng(4)
    seqs = sorted({tuple(rng.integers(0, 40, rng.integers(0, 9)).tolist()) for _ in range(3000)})
    flat = np.array([x for s in seqs for x in s], np.int64)
    starts = np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)
    trie = T.DoubleArray(flat, starts, 40)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert (trie.check >= 0).sum() == len(prefixes)

    def walk(path):
        at = np.zeros(1, np.int64)
        for x in path:
            at = trie.step(at, np.array([x]))
            if at[0] < 0:
                return None
        return int(at[0])

    assert len({walk(p) for p in prefixes}) == len(prefixes) and None not in {walk(p) for p in prefixes}
    missing = {tuple(rng.integers(0, 40, 3).tolist()) for _ in range(500)} - prefixes
    assert missing and {walk(p) for p in missing} == {None}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = list(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    got = T.op13(spark, sf).withColumn("ends_sha256", F.lower("ends_sha256"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rebuilt(sequences(rows)))
