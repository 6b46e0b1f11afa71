"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

A partial partition is a tuple of ``n`` subset sums. Differencing takes the two
partial partitions with the largest spread and joins them oppositely ordered:
the heaviest subset of one with the lightest of the other. It runs in levels:
groups of equal texts are dealt by hash into buckets, each bucket is differenced
to one partial partition, and the partial partitions of many buckets are the
items of the next level, until one is left. Only subset sums and the
group -> subset maps travel, never texts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from .common import query, read, saved


def kk_difference(items: list[list[int]], parts: int) -> tuple[list[list[int]], list[int]]:
    """Difference items (each a list of ``parts`` sums) to one partial partition.

    Returns ``place`` (``place[i][j]`` = final subset of item i's subset j) and
    the final sums, heaviest first. Ties go to the item that came first.
    """
    sums, nodes, heap = [], [], []
    for i, it in enumerate(items):
        order = sorted(range(parts), key=lambda j: (-it[j], j))
        sums.append([it[j] for j in order])
        nodes.append(("leaf", order))
        heap.append((sums[-1][-1] - sums[-1][0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = [sums[a][j] + sums[b][parts - 1 - j] for j in range(parts)]
        order = sorted(range(parts), key=lambda j: (-both[j], j))
        nodes.append(("join", a, b, order))
        sums.append([both[j] for j in order])
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(nodes) - 1))
    place: list = [None] * len(items)
    stack = [(heap[0][1], list(range(parts)))] if heap else []
    while stack:  # target[r]: final subset of the node's r-th heaviest subset
        at, target = stack.pop()
        node = nodes[at]
        if node[0] == "leaf":
            row = [0] * parts
            for r, j in enumerate(node[1]):
                row[j] = target[r]
            place[at] = row
        else:
            _, a, b, order = node
            back = [0] * parts
            for r, j in enumerate(order):
                back[j] = target[r]
            stack.append((a, back))
            stack.append((b, back[::-1]))
    return place, (sums[heap[0][1]] if heap else [0] * parts)


def assign_groups(groups: DataFrame, shards: int, bucket_rows: int = 400) -> DataFrame:
    """``gkey, weight`` (one row per group) -> ``gkey, shard``."""
    n = groups.count()
    buckets = max(1, -(-n // bucket_rows))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "gkey"), F.lit(buckets)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "gkey"], ascending=[False, True], kind="stable")
        place, sums = kk_difference([[w] + [0] * (shards - 1) for w in pdf["weight"].tolist()], shards)
        return pd.DataFrame(
            {
                "gkey": pdf["gkey"].to_numpy(),
                "bucket": pdf["bucket"].to_numpy(),
                "part": np.array([p[0] for p in place], dtype="int32"),
                "weight": pdf["weight"].to_numpy(),
            }
        )

    placed = saved(dealt.groupBy("bucket").applyInPandas(first, "gkey long, bucket long, part int, weight long"))
    sums = placed.groupBy("bucket", "part").agg(F.sum("weight").alias("weight")).withColumnRenamed("bucket", "item")
    out = placed.select("gkey", "bucket", "part")
    while buckets > 1:
        up = max(1, -(-buckets // bucket_rows))

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = sorted(set(pdf["item"].tolist()))
            at = {x: i for i, x in enumerate(ids)}
            rows = [[0] * shards for _ in ids]
            for x, part, w in zip(pdf["item"].tolist(), pdf["part"].tolist(), pdf["weight"].tolist()):
                rows[at[x]][part] = w
            place, _ = kk_difference(rows, shards)
            parent = int(pdf["parent"].iat[0])
            return pd.DataFrame(
                [(x, j, parent, place[i][j], rows[i][j]) for i, x in enumerate(ids) for j in range(shards)],
                columns=["item", "part", "parent", "to_part", "weight"],
            )

        step = saved(
            sums.withColumn("parent", F.pmod(F.xxhash64(F.lit(11), "item"), F.lit(up)) if up > 1 else F.lit(0).cast("long"))
            .groupBy("parent")
            .applyInPandas(combine, "item long, part int, parent long, to_part int, weight long")
        )
        out = (
            out.withColumnRenamed("bucket", "item")
            .join(step.select("item", "part", "parent", "to_part"), ["item", "part"])
            .select("gkey", F.col("parent").alias("bucket"), F.col("to_part").alias("part"))
        )
        sums = (
            step.groupBy("parent", "to_part")
            .agg(F.sum("weight").alias("weight"))
            .select(F.col("parent").alias("item"), F.col("to_part").alias("part"), "weight")
        )
        buckets = up
    return out.select("gkey", F.col("part").alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: byte-balanced shards, equal texts together.

    Size is the UTF-8 length plus 1 (null text: 1, its own group of "equal
    texts"; its crc32 is that of no bytes, 0). Slots count from 0 in doc_id
    order (nulls first) in each shard; repeated rows take neighbouring slots.
    A group heavier than a fair share makes its shard that heavy, since groups
    are not cut. An empty table gives no rows.
    """
    text = F.col(text_col)
    narrow = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text)).alias("gkey"),
        )
    )
    groups = saved(narrow.groupBy("gkey").agg(F.sum("size").alias("weight")))
    placed = narrow.join(assign_groups(groups, shards), "gkey").drop("gkey")
    ranked = saved(global_row_number(placed, ["shard", "doc_id", "size", "text_crc32"], out="_rn"))
    firsts = {r["shard"]: r["f"] for r in ranked.groupBy("shard").agg(F.min("_rn").alias("f")).collect()}
    start = F.element_at(
        F.array(*[F.lit(firsts.get(s, 1)).cast("long") for s in range(shards)]), (F.col("shard") + 1).cast("int")
    )
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_rn") - start).alias("slot"))


@query("op6_shard_documents")
def op6(spark, sf_dir):
    """All ``documents`` into 8 shards under the ``bytes`` law; groups are equal texts."""
    return shard_by_bytes(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
