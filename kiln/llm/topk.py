"""Exact top-k search by a Voronoi kNN join on inner products.

Vectors are grouped by the nearest of a few pivots. Summaries give bounds:

* each query's k-th best score against a bounded sample is a lower bound of its
  final k-th score; the least of a query group is the group's bound ``theta``;
* with ``c`` the centre and ``R`` the radius of a query group, a vector ``x`` scores
  at most ``c.x + R|x|`` with any of its queries, and a whole cell with pivot ``p``,
  radius ``r`` and largest norm ``n`` at most ``c.p + |c|r + Rn``.

A cell, then a vector, is replicated to a query group only if its bound reaches
``theta``. Each group solves locally, slice by slice of its data, and the partial
lists are merged. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, read, saved

#: Rows of the sample behind pivots and bounds, pivots, and query groups: all bounded.
SAMPLE_ROWS, PIVOTS, MAX_GROUPS = 4096, 48, 4096
GROUP_QUERIES, SLICE_ROWS = 256, 8192
_SLACK = 1e-9


def _matrix(column, dim: int) -> np.ndarray:
    """Rows padded with zeros to ``dim`` (int64)."""
    out = np.zeros((len(column), dim), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where every partial sum is an exact integer."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_of(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(row))
    if len(row) > k:
        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
    return at[np.lexsort((ids[at], -row[at]))][:k]


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of k-means over the bounded sample."""
    p = sample[:n].astype(np.float64)
    x = sample.astype(np.float64)
    for _ in range(5):
        near = nearest(x, p)[0]
        p = np.array([x[near == i].mean(axis=0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, np.linalg.norm(x - p[at], axis=1)


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of vectors that are not null and wholly finite.

    Rows with a null id take no part; of several rows with one id the largest
    vector stands (equal rows count once). Shorter vectors count as padded with
    zeros. Products beyond 64-bit integers are outside the operator's domain.
    """
    x = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
    )
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return (
        vectors.filter(F.coalesce(usable, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))
        .groupBy("vec_id")
        .agg(F.max("v").alias("v"))
    )


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows but the
    query's own id. Fewer than k candidates give fewer rows; an empty table or no
    query gives none.
    """
    spark = vectors.sparkSession
    rows = saved(quantized(vectors, id_col, vec_col))
    total, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries = rows.filter(is_query).count()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n_queries or total < 2:
        return spark.createDataFrame([], empty)
    dim = max(1, dim)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    s_ids, s_rows = taken["vec_id"].to_numpy(), _matrix(taken["v"], dim)
    pivots = pivots_of(s_rows, min(PIVOTS, len(s_rows)))

    def place(pdfs):  # every vector to its Voronoi cell
        for pdf in pdfs:
            if len(pdf):
                x = _matrix(pdf["v"], dim).astype(np.float64)
                at, dist = nearest(x, pivots)
                yield pdf.assign(cell=at.astype("int32"), dist=dist, norm=np.linalg.norm(x, axis=1))

    placed = saved(rows.mapInPandas(place, "vec_id long, v array<long>, cell int, dist double, norm double"))
    cells = placed.groupBy("cell").agg(F.max("dist").alias("r"), F.max("norm").alias("n")).collect()

    size = max(GROUP_QUERIES, -(-n_queries // (MAX_GROUPS - len(pivots))))
    queries = placed.filter(is_query)
    per = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts"))
    dealt = queries.join(F.broadcast(per), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["v"], dim), pdf["vec_id"].to_numpy()
        s = scores(x, s_rows).astype(np.float64)
        s[ids[:, None] == s_ids[None, :]] = -np.inf
        theta = np.sort(s, axis=1)[:, -k].min() if s.shape[1] >= k else -np.inf
        c = x.astype(np.float64).mean(axis=0)
        radius = np.linalg.norm(x - c, axis=1).max()
        return pd.DataFrame(
            {"cell": pdf["cell"].iloc[:1].array, "part": pdf["part"].iloc[:1].array, "centre": [c], "radius": radius, "theta": theta}
        )

    groups = (
        dealt.groupBy("cell", "part")
        .applyInPandas(summary, "cell int, part long, centre array<double>, radius double, theta double")
        .toPandas()
        .sort_values(["cell", "part"], ignore_index=True)
    )
    centre = np.stack(groups["centre"].to_numpy())
    radius, theta = groups["radius"].to_numpy(), groups["theta"].to_numpy()
    c_norm = np.linalg.norm(centre, axis=1)
    open_ = np.zeros((len(groups), len(pivots)), dtype=bool)
    for c in cells:
        bound = centre @ pivots[c["cell"]] + c_norm * c["r"] + radius * c["n"]
        open_[:, c["cell"]] = bound * (1 + np.sign(bound) * _SLACK) + _SLACK >= theta
    slices = max(1, -(-total // SLICE_ROWS))

    def replicate(pdfs):
        for pdf in pdfs:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                x = _matrix(part["v"], dim).astype(np.float64)
                bound = x @ centre.T + part["norm"].to_numpy()[:, None] * radius[None, :]
                need = (bound + np.abs(bound) * _SLACK + _SLACK >= theta[None, :]) & open_[:, part["cell"].to_numpy()].T
                row, gid = np.nonzero(need)
                if len(row):
                    got = part.iloc[row]
                    yield pd.DataFrame({"gid": gid.astype("int32"), "vec_id": got["vec_id"].to_numpy(), "v": got["v"].to_numpy()})

    data = placed.mapInPandas(replicate, "gid int, vec_id long, v array<long>").withColumn(
        "slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices))
    )
    numbered = spark.createDataFrame(
        [(int(c), int(p), i) for i, (c, p) in enumerate(zip(groups["cell"], groups["part"]))], "cell int, part long, gid int"
    )
    asked = dealt.join(F.broadcast(numbered), ["cell", "part"]).select(
        "gid", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice")
    )

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = right["vec_id"].to_numpy(), _matrix(right["v"], dim)
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                s = scores(_matrix(part["v"], dim), x)
                for q, row in zip(part["vec_id"].to_numpy(), s):
                    best = best_of(row, ids, k + 1)
                    best = best[ids[best] != q][:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[best], "score": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    partial = (
        asked.groupBy("gid", "slice")
        .cogroup(data.groupBy("gid", "slice"))
        .applyInPandas(solve, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


@query("op7_top_k")
def op7(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all rows of ``embeddings``."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, F.col("vec_id") % 20 == 0, k=20)
