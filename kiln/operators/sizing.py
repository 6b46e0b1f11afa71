"""Size-checked broadcast: hint a join side only after measuring it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Bounds for a lookup table shipped to every task.
DEFAULT_MAX_BROADCAST_ROWS = 4_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_OVERHEAD = 64  # hashed-relation bytes per row besides the variable-width values


def estimated_size(df: DataFrame) -> tuple[int, int]:
    """``(rows, estimated bytes)`` from one distributed aggregate.

    Count and string byte sums are partial aggregates (no global limit, which
    would pull rows into one partition); callers materialize ``df`` first.
    """
    var = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    row = df.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in var]).first()
    n = int(row[0])
    return n, n * _ROW_OVERHEAD + sum(int(v) for v in row[1:])


def broadcast_if_small(
    df: DataFrame,
    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> tuple[DataFrame, bool]:
    """Return ``(df_or_broadcast(df), broadcasted)``.

    The side is measured (row count and the byte length of its string
    columns); only within both bounds is it marked for broadcast. Beyond them
    the plain frame is returned and the join shuffles. Callers materialize
    ``df`` first (``checkpoint``) when it is expensive to build.
    """
    n, size = estimated_size(df)
    if n <= max_rows and size <= max_bytes:
        return F.broadcast(df), True
    return df, False


def measured_join(big: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join ``big`` with a side that is usually small, without shuffling ``big`` when it is.

    ``other`` is written once to the checkpoint folder, measured, and
    broadcast only within the bounds; otherwise the join shuffles both sides
    (and AQE still splits skewed partitions).
    """
    from ..session import checkpoint_dir

    checkpoint_dir(other.sparkSession)
    other = other.checkpoint(eager=True)
    side, _ = broadcast_if_small(other)
    return big.join(side, on, how)


def join_on_nullable(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns that ``stats`` holds for its key; a NULL key matches a NULL key.

    ``stats`` has one row for each key of ``df``, so every row of ``df`` stays.
    """
    renamed = stats.withColumnsRenamed({k: f"_stats_{k}" for k in keys})
    on = None
    for k in keys:
        same = df[k].eqNullSafe(renamed[f"_stats_{k}"])
        on = same if on is None else on & same
    return df.join(renamed, on, "inner").drop(*[f"_stats_{k}" for k in keys])
