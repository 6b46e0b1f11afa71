"""Mixing sources to target weights by the cube method.

Every source gets a target share of all words. A document of a source whose
target is ``r`` times its size is taken ``floor(r)`` times for certain and once
more with inclusion probability ``frac(r)``. The extra copies are drawn by the
cube method: fractional probabilities move through the null space of two
balancing constraints (sum of documents and sum of words stay what they are in
expectation) until they reach 0 or 1.

Flight phase in levels: the units of a source are dealt by hash into groups of
about ``group_rows``; each group flies on its own and leaves at most two units
fractional. The left units of all groups of a source form the next level, so
each level is hundreds of times smaller. Where one group holds all that is left
of a source, the landing phase ends it. A hot source is only more groups.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ..operators.sizing import broadcast_if_small
from .common import n_words, query, read, saved

EPS = 1e-9
_FLIGHT = "sid long, doc_id {id_type}, size long, m long, p double"


def _step(cols: list[list], u: list[float], rng: random.Random) -> None:
    """Move the probabilities along +-u to the nearest face, a martingale step."""
    up = down = float("inf")
    for c, x in zip(cols, u):
        if x > 0:
            up, down = min(up, (1 - c[0]) / x), min(down, c[0] / x)
        elif x < 0:
            up, down = min(up, c[0] / -x), min(down, (1 - c[0]) / -x)
    t = up if rng.random() * (up + down) < down else -down
    for c, x in zip(cols, u):
        c[0] += t * x
        if c[0] < EPS or c[0] > 1 - EPS:
            c[0] = float(round(c[0]))


def _null_vector(cols: list[list]) -> list[float]:
    """A vector u with sum(u*m) = 0 and sum(u*m*size) = 0 for three units."""
    (_, ma, ta, _), (_, mb, tb, _), (_, mc, tc, _) = cols
    u = [mb * tc - mc * tb, mc * ta - ma * tc, ma * tb - mb * ta]
    if not any(u):  # all three alike per document: two of them are enough
        return [mb, -ma, 0]
    scale = max(map(abs, u))
    return [x / scale for x in u]


def cube_flight(p: list[float], m: list[int], size: list[int], seed: int, land: bool) -> list[float]:
    """Fly one group: units in the given order; at most two stay fractional (none if ``land``).

    Callers order the units by falling size, so that what is left for the
    landing is small. The landing gives up the document count first, then the
    words of one last unit.
    """
    rng = random.Random(seed)
    out = list(p)
    window: list[list] = []
    for i in range(len(p)):
        if not EPS < out[i] < 1 - EPS:
            out[i] = float(round(out[i]))
            continue
        window.append([out[i], m[i], m[i] * size[i], i])
        if len(window) == 3:
            _step(window, _null_vector(window), rng)
            for c in window:
                out[c[3]] = c[0]
            window = [c for c in window if 0 < c[0] < 1]
    # Two left: fly on while they are alike, land otherwise.
    while window and (land or (len(window) == 2 and window[0][1] * window[1][2] == window[1][1] * window[0][2])):
        if len(window) == 2:
            a, b = window
            u = [b[2], -a[2]] if a[2] and b[2] else ([1, 0] if b[2] else [0, 1]) if a[2] or b[2] else [b[1], -a[1]]
            if a[2] and b[2]:
                s = max(u[0], -u[1])
                u = [u[0] / s, u[1] / s]
        else:
            u = [1]
        _step(window, u, rng)
        for c in window:
            out[c[3]] = c[0]
        window = [c for c in window if 0 < c[0] < 1]
    return out


def source_targets(sources: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``sid, source, source_size, n_units`` -> with ``target`` (double).

    Weights go to sources in code-point order (null last), repeating. The words
    of all sources are shared by weight; a target stops at ``cap`` times its
    source's size and the excess is reshared by weight until none is above.
    Each round is one aggregate over the sources; two numbers reach the driver.
    """
    ranked = global_row_number(sources, [F.col("source").isNull(), F.col("source")], out="sid")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = saved(ranked.withColumn("weight", w))
    limit = F.col("source_size") * F.lit(float(cap))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weight if weight else 0.0
    while True:
        over = limit < F.col("weight") * F.lit(float(level))
        held, rest = ranked.agg(
            F.sum(F.when(over, limit).otherwise(F.lit(0.0))), F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("weight")))
        ).first()
        after = (total - held) / rest if rest else level
        if after <= level * (1 + 1e-12):
            break
        level = after
    return ranked.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level)))).drop("weight")


def mix_sources(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=(5, 2, 1),
    cap: float = 3.0,
    seed: int = 20,
    group_rows: int = 500,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, m, copies``: one row per unit.

    A unit is all rows with the same id, source and size (``m`` of them;
    usually one); each of its rows is taken ``copies`` times. Null ids, null
    sources and documents without words are units like any other; an empty
    table gives no rows. The draw depends on ids, sizes and ``seed`` alone, so
    reruns agree under any partitioning.
    """
    spark = docs.sparkSession
    units = saved(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    sources = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = saved(
        source_targets(sources, weights, cap)
        .withColumn("base", F.floor(ratio + F.lit(EPS)))
        .withColumn("p0", F.greatest(F.lit(0.0), ratio - F.col("base")))
        .withColumnRenamed("source", "_source")
    )
    side, _ = broadcast_if_small(targets, max_rows=200_000, max_bytes=16 << 20)
    start = units.join(side, units["source"].eqNullSafe(side["_source"]), "inner").select(
        "sid", "doc_id", "size", "m", F.col("p0").alias("p"), "n_units"
    )
    left = start.select("sid", F.col("n_units").alias("n"), "doc_id", "size", "m", "p")
    done: list[DataFrame] = []
    id_type = units.schema["doc_id"].dataType.simpleString()
    level = 0
    while True:
        flown = saved(_fly(left, level, group_rows, seed, id_type))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.filter(~open_))
        rest = flown.filter(open_)
        per = rest.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
        if rest.isEmpty():
            break
        per = saved(per)
        side_n, _ = broadcast_if_small(per, max_rows=200_000, max_bytes=16 << 20)
        left = rest.join(side_n, "sid").select("sid", "n", "doc_id", "size", "m", "p")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(side, "sid").select(
        "doc_id",
        F.col("_source").alias("source"),
        "size",
        "source_size",
        "target",
        "m",
        (F.col("base") + F.col("p")).cast("int").alias("copies"),
    )


def _fly(left: DataFrame, level: int, group_rows: int, seed: int, id_type: str) -> DataFrame:
    """One level: groups of about ``group_rows`` units of a source; a single group also lands."""
    groups = F.ceil(F.col("n") / F.lit(float(group_rows))).cast("long")
    dealt = left.withColumn("n", groups).withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.col("n"))
    )

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        sid, bucket, n = int(pdf["sid"].iat[0]), int(pdf["bucket"].iat[0]), int(pdf["n"].iat[0])
        pdf = pdf.sort_values(["size", "m", "doc_id"], ascending=[False, False, True], kind="stable")
        key = ((seed * 1000003 + sid) * 1000003 + bucket) * 64 + level
        p = cube_flight(pdf["p"].tolist(), pdf["m"].tolist(), pdf["size"].tolist(), key, land=n == 1)
        return pdf[["sid", "doc_id", "size", "m"]].assign(p=np.array(p, dtype="float64"))

    return dealt.groupBy("sid", "bucket").applyInPandas(fly, _FLIGHT.format(id_type=id_type))


@query("op1_mix_sources")
def op1(spark, sf_dir):
    """The whole of ``documents`` mixed; ``taken`` = words the mix takes of a document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mix = mix_sources(docs, n_words(F.col("text")))
    return mix.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "source",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("row_of_unit"),
    )
