"""Dataset mixtures, exact subsamples, splits and samplers.

Randomness is a seeded hash of a unique row key, so every step is
deterministic, independent of partitioning, and re-runnable after executor
loss. "First k of the shuffled order" is exact, never Bernoulli ``sample``:
a histogram of the seeded hash prefix finds the bucket holding the k-th
row, only that bucket is ranked to get the boundary key
(``ranking.first_k_hashed``), and the rows are then selected by a filter.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ranking import first_k_hashed, global_row_number, rank_within_groups, seeded_order_key


@dataclass
class MixtureEntry:
    """One dataset of a mixture: a frame, its unique key, columns and weight."""

    name: str
    df: DataFrame
    key: str
    columns: list[str] | None = None
    weight: float | None = None


@dataclass
class MixtureSpec:
    entries: list[MixtureEntry] = field(default_factory=list)
    seed: int = 0
    test_split_size: float | None = None


def shuffled(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """L1: 1-based position of each row in the seeded shuffle."""
    return global_row_number(df, [seeded_order_key(seed, key), F.col(key)], out=out)


def exact_fraction(df: DataFrame, key: str, seed: int, weight: float | None) -> DataFrame:
    """L2: the first ``int(n * weight)`` rows of the seeded shuffle; None keeps all."""
    if weight is None:
        return df
    return first_k_hashed(df, [seeded_order_key(seed, key), F.col(key)], lambda n: int(n * weight))


def check_columns(frames: Sequence[DataFrame]) -> None:
    """Every mixture entry must select the same set of columns."""
    sets = [frozenset(f.columns) for f in frames]
    if len(set(sets)) > 1:
        raise ValueError("every entry of a mixture must select the same columns")


#: Hex digits of a shuffle hash that number a bucket (65,536 counts for each entry reach the driver).
BUCKET_HEX = 4


def _bucket(order_key: Column) -> Column:
    return F.conv(F.substring(order_key, 1, BUCKET_HEX), 16, 10).cast("int")


def _selected_parts(spec: MixtureSpec) -> list[DataFrame]:
    """Each entry's selected columns with its name (``mixture_entry``), key (``_key``) and selection hash (``_sel``)."""
    parts = []
    for e in spec.entries:
        cols = e.columns if e.columns is not None else list(e.df.columns)
        keyed = [F.lit(e.name).alias("mixture_entry"), F.col(e.key).cast("string").alias("_key")]
        parts.append(e.df.select(*cols, *keyed, seeded_order_key(spec.seed, e.key).alias("_sel")))
    check_columns([p.drop("mixture_entry", "_key", "_sel") for p in parts])
    return parts


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def boundary_buckets(histogram: Mapping[int, int], weight: float) -> tuple[int, int] | None:
    """``(bucket, rows of it to take)`` of the first ``int(n * weight)`` rows; None takes all."""
    left = int(sum(histogram.values()) * weight)
    for bucket in sorted(histogram):
        if left <= histogram[bucket]:
            return bucket, left
        left -= histogram[bucket]
    return None


def mixture_rows(spec: MixtureSpec) -> DataFrame:
    """Select → exact subsample of every entry → union, written once (L2, L3).

    The boundaries of all entries are found together: one histogram by ``(entry,
    hash prefix)`` over the narrow keys, one write of the rows up to each entry's
    boundary bucket, and one ranking of all boundary buckets over what was
    written. Each table is read twice, once for its keys and once for its rows.
    """
    parts = _selected_parts(spec)
    weights = {e.name: e.weight for e in spec.entries}
    weighed = [p for e, p in zip(spec.entries, parts) if e.weight is not None]
    counts: dict[str, dict[int, int]] = {e.name: {} for e in spec.entries}
    if weighed:
        narrow = _union([p.select("mixture_entry", _bucket(F.col("_sel")).alias("_b")) for p in weighed])
        for r in narrow.groupBy("mixture_entry", "_b").count().collect():
            counts[r["mixture_entry"]][-1 if r["_b"] is None else r["_b"]] = r["count"]
    edges = {n: boundary_buckets(counts[n], w) for n, w in weights.items() if w is not None}

    def up_to_edge(e: MixtureEntry, p: DataFrame) -> DataFrame:
        edge = edges.get(e.name)
        b = F.coalesce(_bucket(F.col("_sel")), F.lit(-1))
        p = p.filter(b <= edge[0]) if edge else p
        return p.withColumn("_edge", b == edge[0] if edge else F.lit(False))

    spark = spec.entries[0].df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"mixture-{uuid.uuid4().hex}")
    _union([up_to_edge(e, p) for e, p in zip(spec.entries, parts)]).write.parquet(path)
    rows = spark.read.parquet(path)
    if not any(edges.values()):
        return rows.drop("_edge", "_sel")
    # All boundary buckets in one ranking; the last row that each entry takes is one row for the driver.
    order = ["mixture_entry", "_sel", "_key"]
    ranked = rank_within_groups(rows.filter("_edge").select(*order), order[:1], order[1:], out="_rk")
    wanted = F.create_map(*[F.lit(x) for n, e in edges.items() if e for x in (n, e[1])])
    last = {r["mixture_entry"]: r for r in ranked.filter(F.col("_rk") == wanted[F.col("mixture_entry")]).collect()}
    keep = ~F.col("_edge")
    for name, r in last.items():
        edge = F.struct(F.lit(r["_sel"]).cast("string").alias("_sel"), F.lit(r["_key"]).cast("string").alias("_key"))
        within = F.struct("_sel", "_key") <= edge
        keep = keep | ((F.col("mixture_entry") == name) & F.col("_edge") & within)
    return rows.filter(keep).drop("_edge", "_sel")


def build_mixture(spec: MixtureSpec) -> dict[str, DataFrame]:
    """L3: select → subsample → union → seeded shuffle → optional train/test split.

    Output frames carry ``mixture_entry`` (entry name) and ``position`` (1-based
    shuffled order). Entry keys need only be unique within their entry.

    Positions need no sampled range and no second write: the shuffle's hash is
    uniform, so its prefix buckets are even, a bucket's rows are ranked by
    themselves, and the counts of the buckets before it give the offset.
    """
    if not spec.entries:
        raise ValueError("a mixture needs at least one entry")
    rows = mixture_rows(spec).withColumn("_hash", seeded_order_key(spec.seed, "mixture_entry", "_key"))
    rows = rows.withColumn("_b", F.coalesce(_bucket(F.col("_hash")), F.lit(-1)))
    sizes = sorted(rows.groupBy("_b").count().collect())
    before, total = [], 0
    for b, n in sizes:
        before.append((b, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_b int, _before long")
    inside = Window.partitionBy("_b").orderBy("_hash", "mixture_entry", "_key")
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(offsets), "_b")
    ranked = placed.withColumn("position", F.col("_before") + F.col("_in")).drop("_b", "_before", "_in", "_hash", "_key")
    if spec.test_split_size is None:
        return {"train": ranked}
    return train_test_split(ranked, "position", spec.test_split_size, total)


def train_test_split(ranked: DataFrame, position: str, test_size: float, n: int | None = None) -> dict[str, DataFrame]:
    """L4: test = first ``ceil(n * f)`` shuffled rows (``f < 1``) or the first ``f`` rows."""
    n = ranked.count() if n is None else n
    n_test = math.ceil(n * test_size) if test_size < 1 else int(test_size)
    return {
        "train": ranked.filter(F.col(position) > F.lit(n_test)),
        "test": ranked.filter(F.col(position) <= F.lit(n_test)),
    }


def pad_to_multiple(df: DataFrame, key: str, multiple: int = 32, seed: int = 0) -> DataFrame:
    """Append rows drawn with replacement until the row count is a multiple.

    Row ``i`` of the padding (``i < pad``, at most ``multiple - 1`` rows) is the
    row ranked ``first 8 hex digits of md5("<seed>:<i>") mod n, plus 1``; padding rows get
    ``is_padding = true``.
    """
    n = df.count()
    pad = (multiple - n % multiple) % multiple
    base = df.withColumn("is_padding", F.lit(False))
    if pad == 0 or n == 0:
        return base
    # Rank only the keys; the (< multiple) picked keys are broadcast back to the rows.
    ranked = global_row_number(df.select(key), [F.col(key)], out="_rk")
    picks = df.sparkSession.range(pad).select(
        (
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
            % F.lit(n)
            + 1
        ).alias("_rk")
    )
    picked = ranked.join(F.broadcast(picks), "_rk", "inner").select(key)
    extra = df.join(F.broadcast(picked), key, "inner").withColumn("is_padding", F.lit(True))
    return base.unionByName(extra)


def repeat_sampler(
    df: DataFrame,
    key: str,
    mini_repeat_count: int,
    batch_size: int = 1,
    repeat_count: int = 1,
    shuffle: bool = True,
    seed: int = 0,
) -> DataFrame:
    """The index stream of a repeat sampler as rows ``(sample_pos, key)``.

    Rows are ordered (seeded shuffle or by key), cut into chunks of
    ``batch_size`` (an incomplete last chunk is dropped); each chunk is emitted
    ``repeat_count`` times and each index ``mini_repeat_count`` times in a row.
    Expansion factors are configuration constants, so each input row becomes
    at most ``repeat_count * mini_repeat_count`` rows in its own task.
    """
    order = [seeded_order_key(seed, key), F.col(key)] if shuffle else [F.col(key)]
    n = df.count()
    full_chunks = n // batch_size
    r = global_row_number(df, order, out="_rk")
    r = r.withColumn("_chunk", F.floor((F.col("_rk") - 1) / batch_size).cast("long")).withColumn(
        "_in", ((F.col("_rk") - 1) % batch_size).cast("long")
    )
    r = r.filter(F.col("_chunk") < F.lit(full_chunks))
    r = r.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeat_count - 1))))
    r = r.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(mini_repeat_count - 1))))
    per_chunk = batch_size * repeat_count * mini_repeat_count
    pos = (
        F.col("_chunk") * per_chunk
        + F.col("_rep") * (batch_size * mini_repeat_count)
        + F.col("_in") * mini_repeat_count
        + F.col("_m")
    )
    return r.withColumn("sample_pos", pos.cast("long")).drop("_rk", "_chunk", "_in", "_rep", "_m")


def split_into_chunks(df: DataFrame, order: Sequence, k: int, out: str = "chunk") -> DataFrame:
    """K chunks of ``n // k`` consecutive rows; the remainder is dropped."""
    n = df.count()
    size = n // k
    if size == 0:
        return df.limit(0).withColumn(out, F.lit(0).cast("long"))
    r = global_row_number(df, order, out="_rk")
    r = r.withColumn(out, F.floor((F.col("_rk") - 1) / size).cast("long"))
    return r.filter(F.col(out) < F.lit(k)).drop("_rk")


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows by ``order`` (a top-k: bounded by n)."""
    return df.orderBy(*order).limit(n)
