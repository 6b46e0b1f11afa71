"""Connected components of an edge table, smallest id as label, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rows of an edge or label table that one partition holds, so that the rounds of a small graph leave few files.
PARTITION_ROWS = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``a, b`` (longs, any direction, repeats allowed) -> ``node, label`` for every node of an edge.

    Labels fall to the smallest neighbour's label and then jump to their label's
    label, so long chains halve with each round. Rounds are written to the shared
    folder; only the number of changed labels reaches the driver.
    """
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-2 * edges.count() // PARTITION_ROWS))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both.coalesce(parts))
    lab = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    lab = saved(lab.coalesce(parts))
    while True:
        near = (
            both.join(lab.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        )
        hooked = lab.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        jump = lab.select(F.col("node").alias("m"), F.col("label").alias("far"))
        after = saved(
            hooked.join(jump, "m").select(
                "node", F.least("m", "far").alias("label"), (F.least("m", "far") != F.col("label")).alias("moved")
            ).coalesce(parts)
        )
        lab = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return lab
