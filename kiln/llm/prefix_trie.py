"""Prefix trie of conversations in double arrays, one per prefix shard.

Distinct turns (role, text) get dense ids, a conversation becomes its sequence of
ids, and equal sequences are one row with its count, smallest member and digest
of members. Sequences are dealt out by a prefix: its first turn, or, where too
many share it, the first 2, 4, 8, ... turns, so no shard grows with one common
beginning. A task packs its shard into BASE and CHECK arrays (child = BASE[node] +
id, CHECK[child] = node) and walks them for the nodes' aggregates. Nodes at or
below a shard's prefix lie in that shard alone; the nodes above it are shared,
and their partial aggregates are merged by their path.

Of a conversation only ``(turn, id, size)`` is ever gathered in one row, and of a
group of equal conversations only ids packed to strings, in a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ..operators.sizing import broadcast_if_small
from .common import query, read, saved

#: Turns that a shard holds (a single longer sequence is a shard of its own).
SHARD_TURNS = 200_000
#: A prefix is never split for fewer turns than this.
LEAST_SPLIT = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = (
    "upper boolean, path array<binary>, parent binary, depth long, size long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


class DoubleArray:
    """A trie over sequences of ids ``0 .. n_ids - 1``, built level by level; node 0 is the root.

    ``flat`` holds all sequences one after another, ``starts`` where each begins
    (and the end). A node with one child takes the next free slot; one with more
    takes the first base at which all its children's slots are free.
    """

    WINDOW = 4096

    def __init__(self, flat: np.ndarray, starts: np.ndarray, n_ids: int):
        self.n_ids = max(1, n_ids)
        self.base = np.zeros(2 * self.n_ids + 1, np.int64)
        self.check = np.full(2 * self.n_ids + 1, -1, np.int64)
        self.check[0], self.low = 0, self.n_ids  # slots below n_ids stay unused, so that no base is negative
        lengths, at = np.diff(starts), np.zeros(len(starts) - 1, np.int64)
        for d in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > d)
            pairs, back = np.unique(at[on] * self.n_ids + flat[starts[on] + d], return_inverse=True)
            at[on] = self._add(pairs // self.n_ids, pairs % self.n_ids)[back]

    def _room(self, top: int) -> None:
        if top >= len(self.check):
            more = max(top + 1 - len(self.check), len(self.check) // 2)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        self._room(self.low + 2 * n)
        while len(free := np.flatnonzero(self.check[self.low :] < 0)) < n:
            self._room(len(self.check) + n)
        return free[:n] + self.low

    def _add(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of the children ``ids`` (ascending for each of the ascending ``parents``)."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(np.r_[first, len(parents)])
        for i, n in zip(first[count > 1], count[count > 1]):
            own = ids[i : i + n]
            self.base[parents[i]] = b = self._fit(own)
            self.check[b + own] = parents[i]
        single = first[count == 1]
        if len(single):
            slots = self._free(len(single))
            self.base[parents[single]] = slots - ids[single]
            self.check[slots] = parents[single]
            self.low = int(slots[-1]) + 1
        return self.base[parents] + ids

    def _fit(self, ids: np.ndarray) -> int:
        offsets, at = ids - ids[0], self.low
        while True:
            self._room(at + self.WINDOW + int(offsets[-1]))
            slots = np.flatnonzero(self.check[at : at + self.WINDOW] < 0) + at
            for o in offsets[1:]:
                slots = slots[self.check[slots + o] < 0]
            if len(slots):
                return int(slots[0] - ids[0])
            at += self.WINDOW

    def step(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children by ``ids``; -1 where there is none."""
        slots = self.base[nodes] + ids
        inside = slots < len(self.check)
        slots = np.where(inside, slots, 0)
        return np.where(inside & (slots > 0) & (self.check[slots] == nodes), slots, -1)


def _first_seen(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``ids`` numbered anew in the order in which they are met level by level, so that siblings get near numbers."""
    depth = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
    order = np.argsort(depth, kind="stable")
    _, first, back = np.unique(ids[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    out = np.empty(len(ids), np.int64)
    out[order] = rank[back]
    return out


def shard_nodes(shard: pa.Table) -> pa.Table:
    """All nodes of one shard's trie (:data:`NODES`); those above a sequence's prefix are partial and marked ``upper``."""
    shard = shard.sort_by("conv_id")
    col = {n: shard.column(n).combine_chunks() for n in shard.column_names}
    conv, count, cut = (col[n].to_numpy(zero_copy_only=False) for n in ("conv_id", "n", "cut"))
    starts = np.r_[0, np.cumsum(np.diff(col["ids"].offsets.to_numpy()))].astype(np.int64)
    ids, sizes = (col[n].flatten().to_numpy(zero_copy_only=False) for n in ("ids", "sizes"))
    dense = _first_seen(ids, starts)
    trie = DoubleArray(dense, starts, int(dense.max(initial=0)) + 1)

    slots = len(trie.check)
    n_convs, children, leaves, saved_, size, depth, split = (np.zeros(slots, np.int64) for _ in range(7))
    first, gid = np.full(slots, np.iinfo(np.int64).max), np.zeros(slots, np.int64)
    ends = np.zeros(slots, np.int64)  # place of the sequence that ends there, from 1
    lengths, at, levels = np.diff(starts), np.zeros(len(conv), np.int64), []
    for d in range(int(lengths.max(initial=0)) + 1):
        on = np.flatnonzero(lengths >= d)
        if d:
            places = starts[on] + d - 1
            at[on] = trie.step(at[on], dense[places])
            size[at[on]], gid[at[on]] = sizes[places], ids[places]
        nodes = at[on]
        np.add.at(n_convs, nodes, count[on])
        np.minimum.at(first, nodes, conv[on])
        depth[nodes], split[nodes] = d, cut[on]
        over = lengths[on] == d
        ends[nodes[over]] = on[over] + 1
        levels.append(np.unique(nodes))

    for nodes in levels[:0:-1]:
        deep = nodes[depth[nodes] >= split[nodes]]
        leaves[deep] += children[deep] == 0
        saved_[deep] += (n_convs[deep] - 1) * size[deep]
        parents = trie.check[deep]
        np.add.at(children, parents, 1)
        np.add.at(leaves, parents, leaves[deep])
        np.add.at(saved_, parents, saved_[deep])

    nodes = np.concatenate(levels)
    upper = depth[nodes] < split[nodes]
    paths: dict[int, list[bytes]] = {0: [b""]}
    for node in nodes[upper].tolist():  # parents come first
        if node:
            above = paths[int(trie.check[node])]
            paths[node] = [*above, hashlib.sha256(above[-1] + int(gid[node]).to_bytes(8, "little", signed=True)).digest()]
    parents = trie.check[nodes]
    top = (~upper & (depth[parents] < split[parents])).tolist()
    told = col["ends_sha256"].to_pylist()
    return pa.table(
        {
            "upper": upper,
            "path": pa.array([paths[n] if u else None for n, u in zip(nodes.tolist(), upper)], pa.list_(pa.binary())),
            "parent": pa.array([paths[p][-1] if t else None for p, t in zip(parents.tolist(), top)], pa.binary()),
            "depth": depth[nodes],
            "size": size[nodes],
            "conv_id": first[nodes],
            "parent_conv_id": pa.array(first[parents], mask=upper | np.array(top, bool)),
            "n_convs": n_convs[nodes],
            "n_children": children[nodes],
            "n_leaves": leaves[nodes],
            "saved_tokens": saved_[nodes],
            "ends_sha256": pa.array([told[e - 1] if e else None for e in ends[nodes].tolist()], pa.string()),
        }
    )


def turn_sequences(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> one row per conversation: ``conv_id, ids, sizes`` in turn order.

    ``ids`` are dense numbers of distinct (role, text), ``sizes`` the texts' UTF-8
    bytes. Turns stand by ``turn`` (null first), then role, then text; repeated
    rows stay; a null role or text is empty. Rows without a ``conv_id`` belong to
    no conversation and are left out.
    """
    rows = rows.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ranked = global_row_number(rows.select("role", "text").distinct(), ["role", "text"], out="id")
    turns = ranked.select(key.alias("_key"), "id", F.octet_length("text").cast("long").alias("size"))
    found = rows.select("conv_id", "turn", key.alias("_key")).join(turns, "_key")
    listed = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("t"))
    return listed.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """Equal sequences as one row: ``conv_id`` (smallest member), ``n``, ``ends_sha256``, ``ids, sizes``."""
    key = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    packed = (
        seqs.select(key.alias("key"), "conv_id", F.shiftright("conv_id", 12).alias("block"))
        .groupBy("key", "block")
        .agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("conv_id")).alias("members"))
        .select("key", "block", "first", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))
    )

    def digest(batches):
        now = first = digest_ = None
        n = 0
        for b in batches:
            out = []
            for k, f, c, m in zip(*(b.column(x).to_pylist() for x in ("key", "first", "n", "members"))):
                if k != now:
                    if now is not None:
                        out.append((first, n, digest_.hexdigest()))
                    now, first, n, digest_ = k, f, 0, hashlib.sha256()
                digest_.update((("," if n else "") + m).encode())
                n += c
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((first, n, digest_.hexdigest()), kinds)], names=names)

    kinds, names = (pa.int64(), pa.int64(), pa.string()), ["conv_id", "n", "ends_sha256"]
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.repartition(parts, "key").sortWithinPartitions("key", "block")
    groups = dealt.mapInArrow(digest, "conv_id long, n long, ends_sha256 string")
    return groups.join(seqs, "conv_id")


def with_shards(seqs: DataFrame) -> DataFrame:
    """``seqs`` with ``cut`` (turns of its shard's prefix) and ``shard``.

    A prefix that holds more than its share of turns is cut at twice its length;
    all its sequences go on, so that nodes above the cut are above it for all.
    """
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = F.size("ids").cast("long") + 1
    total = seqs.agg(F.coalesce(F.sum(turns), F.lit(0))).first()[0]
    most = min(SHARD_TURNS // 2, max(LEAST_SPLIT, total // (4 * parts)))
    shards = max(4 * parts, -(-total // SHARD_TURNS))

    def prefix(k: Column | int) -> Column:
        return F.slice("ids", F.lit(1), F.lit(k) if isinstance(k, int) else k)

    k, done = 1, seqs.withColumn("cut", F.lit(1))
    while True:
        heavy = saved(
            done.filter(F.col("cut") == k)
            .groupBy(prefix(k).alias("_prefix"))
            .agg(F.sum(turns).alias("_turns"), F.count(F.lit(1)).alias("_n"))
            .filter((F.col("_turns") > most) & (F.col("_n") > 1))
            .select("_prefix")
        )
        if heavy.isEmpty():
            break
        side, _ = broadcast_if_small(heavy, max_rows=100_000)
        same = (F.col("cut") == k) & (prefix(k) == F.col("_prefix"))
        cut = F.when(F.col("_prefix").isNotNull(), F.lit(2 * k)).otherwise(F.col("cut"))
        done = saved(done.join(side, same, "left").withColumn("cut", cut).drop("_prefix"))
        k *= 2
    return done.withColumn("shard", F.pmod(F.xxhash64(prefix(F.col("cut"))), F.lit(shards)))


def trie_nodes(seqs: DataFrame) -> DataFrame:
    """Every node of the prefix trie of ``conv_id, ids, sizes`` (one row per conversation).

    Returns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``. No conversations, no nodes; one without
    turns ends at the root.
    """
    dealt = with_shards(saved(distinct_sequences(seqs)))
    nodes = saved(
        dealt.select("shard", "conv_id", "n", "cut", "ids", "sizes", "ends_sha256").groupBy("shard").applyInArrow(shard_nodes, NODES)
    )
    key = F.element_at("path", -1)
    above = saved(
        nodes.filter("upper")
        .groupBy("path", "depth", "size")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"),
        )
        .withColumn("key", key)
        .withColumn("parent", F.when(F.col("depth") > 0, F.get("path", F.col("depth").cast("int") - 1)))
    )
    kids = above.groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("_kids"))
    own = saved(
        above.join(kids, F.col("key") == F.col("_of"), "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
        .withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
        .drop("_of", "_kids")
    )
    sums = (
        own.select(F.explode("path").alias("_of"), "n_leaves", "saved_tokens")
        .groupBy("_of")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    )
    merged = saved(
        own.drop("n_leaves", "saved_tokens").join(sums, F.col("key") == F.col("_of")).drop("_of", "path", "size")
    )
    named, _ = broadcast_if_small(saved(merged.select(F.col("key").alias("_of"), F.col("conv_id").alias("_first"))), max_rows=1_000_000)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    shared = merged.join(named, F.col("parent") == F.col("_of"), "left").withColumn("parent_conv_id", F.col("_first"))
    below = nodes.filter("NOT upper")
    tops = below.filter("parent IS NOT NULL").join(named, F.col("parent") == F.col("_of")).withColumn("parent_conv_id", F.col("_first"))
    rest = below.filter("parent IS NULL")
    return shared.select(*out, ends).unionByName(tops.select(*out, ends)).unionByName(rest.select(*out, ends))


def rebuilt(seqs: DataFrame, every: int = 5, spread: int = 9) -> DataFrame:
    """Conversation ``c`` with its first ``h`` turns taken from conversation ``c - c % every``.

    ``h`` is the unsigned crc32 of the decimal ``c`` modulo ``spread``; an absent
    conversation gives no turns.
    """
    most = spread - 1
    heads = seqs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("ids", 1, most).alias("_ids"), F.slice("sizes", 1, most).alias("_sizes")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(spread)).cast("int")
    none = F.array().cast("array<long>")

    def swap(own: str, base: str) -> Column:
        return F.concat(F.slice(F.coalesce(base, none), F.lit(1), F.col("_h")), F.slice(own, F.col("_h") + 1, F.size(own))).alias(own)

    at = F.col("conv_id") - F.col("conv_id") % every
    joined = seqs.withColumn("_h", h).join(heads, at == F.col("_base"), "left")
    return joined.select("conv_id", swap("ids", "_ids"), swap("sizes", "_sizes"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS own,
  xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(a, b)),
    4294967295), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
s AS (SELECT a.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1:a.h] END, a.own[a.h + 1:]) AS seq
  FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s),
n AS (SELECT seq[1:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(any_value(seq[d].x))) END AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = d), '')) AS ends_sha256
  FROM p GROUP BY seq[1:d], d),
k AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
o AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node AND n.depth = k.depth),
a AS (SELECT node, depth, n_convs, bytes, n_children, unnest(range(0, depth + 1)) AS up FROM o),
b AS (SELECT node[1:up] AS node, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * bytes) AS saved_tokens FROM a GROUP BY 1, 2)
SELECT o.conv_id, o.depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN b ON o.node = b.node AND o.depth = b.depth
LEFT JOIN n q ON q.depth = o.depth - 1 AND q.node = o.node[1:o.depth - 1]
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, sf_dir):
    """All ``conversations``, rebuilt from their fives, as the nodes of one prefix trie."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie_nodes(saved(rebuilt(saved(turn_sequences(rows)))))
