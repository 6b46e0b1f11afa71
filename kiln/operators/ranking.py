"""Exact global row numbers without a single-partition window (W4, W5, SRC7, L*).

``row_number() OVER (ORDER BY k)`` with no partition moves every row into one
task. Instead: range-partition on the order key (Spark samples the bounds, so
partitions are balanced for any key distribution without heavy ties), sort
within partitions, count rows per partition (a list as long as the number of
partitions, the only thing that reaches the driver), and add each partition's
offset to the row's index inside its partition.

The range partitioner samples with a seed derived from the RDD id, so two
separate jobs over the same plan can draw different bounds. The tagged rows
are therefore written once with a reliable ``checkpoint()`` (to the shared
``spark.checkpoint.dir``): the count and the numbering both read the same
partitions, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .sizing import join_on_nullable

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row index


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_row_number(
    df: DataFrame,
    order: Sequence[str | Column],
    out: str = "row_number",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 1-based ``out`` column: the row's position in the total order.

    Rows equal on every order column get consecutive numbers in an
    unspecified order among themselves (as ``row_number`` does).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _order_cols(order)
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    counts = dict(tagged.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for p in range(n):
        offsets.append(acc)
        acc += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_pid") + 1)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    return tagged.withColumn(out, off + local + F.lit(1)).drop("_pid", "_mid")


def order_values_at(df: DataFrame, order: Sequence[str | Column], ranks: Sequence[int]) -> dict[int, tuple]:
    """The order-key tuples at the given 1-based ranks (at most ``len(ranks)`` rows reach the driver).

    Only a narrow projection of the order keys is ranked and checkpointed.
    """
    cols = _order_cols(order)
    narrow = df.select(*[c.alias(f"_o{i}") for i, c in enumerate(cols)])
    names = [f"_o{i}" for i in range(len(cols))]
    ranked = global_row_number(narrow, names, out="_rk")
    rows = ranked.filter(F.col("_rk").isin(*[int(r) for r in ranks])).collect()
    return {r["_rk"]: tuple(r[n] for n in names) for r in rows}


def order_key(order: Sequence[str | Column]) -> Column:
    """The order keys as one struct; structs compare field by field."""
    return F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(_order_cols(order))])


def key_literal(values: tuple, like: DataFrame, order: Sequence[str | Column]) -> Column:
    """A struct literal with the same field types as :func:`order_key`."""
    types = like.select(order_key(order).alias("k")).schema["k"].dataType
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, types.fields)])


def first_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows in a unique total order, as a filter on the original rows.

    The k-th key is found on a narrow ranked projection; the table itself is
    only filtered (no full-row shuffle, sort or write).
    """
    if k <= 0:
        return df.limit(0)
    at = order_values_at(df, order, [k])
    if k not in at:
        return df
    return df.filter(order_key(order) <= key_literal(at[k], df, order))


HASH_PREFIX_HEX = 4  # 16**4 = 65,536 histogram buckets


def first_k_hashed(df: DataFrame, order: Sequence[str | Column], k) -> DataFrame:
    """:func:`first_k` for orders led by a uniform hex hash (e.g. ``seeded_order_key``).

    1. histogram of the hash's 4-hex-digit prefix (a partial aggregate; at
       most 65,536 counts reach the driver);
    2. the bucket holding the k-th row and how many rows of it are needed;
    3. only that bucket's rows are ranked to find the boundary key;
    4. the table is filtered by ``order key <= boundary``.
    No step shuffles or writes all rows. ``k`` may be a function of the row
    count (e.g. ``lambda n: int(n * w)``); the histogram provides the count.
    """
    cols = _order_cols(order)
    bucket = F.conv(F.substring(cols[0], 1, HASH_PREFIX_HEX), 16, 10).cast("int")
    bucket = F.coalesce(bucket, F.lit(-1))  # NULL keys come first
    hist = sorted(df.select(bucket.alias("_b")).groupBy("_b").count().collect())
    if callable(k):
        k = k(sum(c for _, c in hist))
    if k <= 0:
        return df.limit(0)
    seen = 0
    for b, c in hist:
        if seen + c >= k:
            inside = df.filter(bucket == F.lit(b))
            at = order_values_at(inside, order, [k - seen])
            return df.filter(order_key(order) <= key_literal(at[k - seen], df, order))
        seen += c
    return df


def rank_within_groups(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """1-based position inside each group, skew-safe.

    A global row number over ``(group, order)`` splits even a group holding
    a third of all rows across many tasks; the group's first number comes
    from a partial aggregation and is joined back on the group key.
    """
    g = global_row_number(df, [*group, *order], out="_g")
    first = g.groupBy(*group).agg(F.min("_g").alias("_g0"))
    return join_on_nullable(g, first, list(group)).withColumn(out, F.col("_g") - F.col("_g0") + 1).drop("_g", "_g0")


def seeded_order_key(seed: int, *keys: str | Column) -> Column:
    """L1: ``md5("<seed>:<key>[:<key2>…]")`` — deterministic, independent of partitioning."""
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.md5(F.concat(*parts))


def row_slice(df: DataFrame, order: Sequence[str | Column], start: int, end: int | None) -> DataFrame:
    """SRC7: rows ``[start, end)`` of the table in a unique order (0-based, like ``range``).

    The boundary keys are read from a narrow ranked projection; the rows are
    then selected with a range predicate on the order key.
    """
    wanted = [r for r in (start, end) if r is not None and r > 0]
    at = order_values_at(df, order, wanted)
    cond = F.lit(True)
    key = order_key(order)
    if start > 0:
        if start not in at:
            return df.limit(0)
        cond = cond & (key > key_literal(at[start], df, order))
    if end is not None and end in at:
        cond = cond & (key <= key_literal(at[end], df, order))
    elif end is not None and end <= 0:
        return df.limit(0)
    return df.filter(cond)


def batch_ids(df: DataFrame, order: Sequence[str | Column], batch_size: int, out: str = "batch") -> DataFrame:
    """W4 + W5: ``row_id`` (0-based) and fixed-size batch number.

    ``batch_size < 1`` means one batch holding everything (the behaviour the
    scoring code documents for "all in parallel").
    """
    r = global_row_number(df, order, out="_rn").withColumn("row_id", F.col("_rn") - 1)
    b = F.lit(0).cast("long") if batch_size < 1 else F.floor(F.col("row_id") / F.lit(batch_size)).cast("long")
    return r.withColumn(out, b).drop("_rn")
