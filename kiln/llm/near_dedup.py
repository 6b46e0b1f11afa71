"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with the same shingle set form one class (its smallest id stands
   for it), so copies never meet as pairs.
2. Classes are banded by MinHash. In each band bucket every member is a
   candidate of the bucket's smallest id: a star, linear in the bucket.
3. Candidates are compared batch by batch of their signatures. With a uniform
   prior the posterior of the similarity after ``n`` values with ``m`` matches is a
   Beta; a pair goes as soon as the chance of being similar falls under ``MISS``.
4. Survivors are verified on the full shingle sets of their texts, first the best
   partner of each class, then those that would join different components.
5. Buckets that still hold several components are finished exactly: their
   members are compared across components in blocks of bounded weight, by
   signature and then on full sets, each pair in the first bucket it shares.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from .common import query, read, saved
from .components import connected_components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
#: Chance of missing a pair of the wanted similarity that the pruning may take at each batch.
MISS = 1e-6
#: Shingles that a block of a bucket holds, and texts that stand beside one partner.
BLOCK_SHINGLES = 400_000
STAR_TEXTS = 200
MEMO_WORDS = 400_000

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (a shorter text is one shingle)."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def shingle_set(text: str | None, k: int) -> set:
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(h), 2048):
        part = np.multiply.outer(_A, h[i : i + 2048])
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    cells = sig.reshape(BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, i])
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """For each batch end ``n``: the fewest matches with P(similarity >= t | matches) >= miss.

    Signatures are compared by one byte of each value, so a value matches with
    probability s + (1 - s) / 256. With a uniform prior on that probability the
    posterior is Beta(m + 1, n - m + 1), whose upper tail at p is
    P(Bin(n + 1, p) <= m).
    """
    p = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        cdf, m = 0.0, 0
        while True:
            cdf += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if cdf >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def sequential_matches(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Matches of signature pairs (rows of bytes), -1 where a batch pruned the pair."""
    total = np.zeros(len(a), dtype=np.int64)
    alive = np.arange(len(a))
    start = 0
    for n, least in least_matches(percent):
        total[alive] += (a[alive, start:n] == b[alive, start:n]).sum(axis=1)
        gone = total[alive] < least
        total[alive[gone]] = -1
        alive, start = alive[~gone], n
    return total


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, f1, f2, sig, bands`` of each row (sig and bands null without words)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(pdfs):
        for pdf in pdfs:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                n, f1, f2, sigs, bands = [], [], [], [], []
                for text in part["text"]:
                    s = shingle_hashes(words_of(text), k)
                    n.append(len(s))
                    f1.append(int(_mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    f2.append(int(_mix(s ^ np.uint64(0x5555)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    sig = minhash(s) if len(s) else None
                    sigs.append(None if sig is None else sig.astype(np.uint8).tobytes())
                    bands.append(None if sig is None else band_keys(sig))
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].array, "n_shingles": n, "f1": f1, "f2": f2, "sig": sigs, "bands": bands}
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if id_type != "string":  # ids with nulls must not turn into floats
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = rows.mapInPandas(run, "doc_id string, n_shingles long, f1 long, f2 long, sig binary, bands array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def _pruned(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``a, b`` -> ``a, b, matches`` of the pairs that stay possible (by set sizes, then by signatures)."""
    side = reps.select("rep", "n_shingles", "sig")
    both = pairs.join(side.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a").join(
        side.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b"
    )
    both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(pdfs):
        for pdf in pdfs:
            if len(pdf):
                one = np.frombuffer(b"".join(pdf["sa"]), dtype=np.uint8).reshape(-1, HASHES)
                two = np.frombuffer(b"".join(pdf["sb"]), dtype=np.uint8).reshape(-1, HASHES)
                m = sequential_matches(one, two, percent)
                yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "matches": m})[m >= 0]

    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long, matches long")


def _texts_of(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the classes ``rep``; the others stay out of the shuffle while the ids may be broadcast."""
    side, _ = broadcast_if_small(saved(reps.distinct()), max_rows=500_000, max_bytes=16 << 20)
    return texts.join(side, "rep", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b`` -> the pairs whose full shingle sets are similar.

    Partners ``a`` stand beside one ``b`` in groups of about ``STAR_TEXTS``: the
    text of ``b`` travels once for each group, each text of ``a`` once for a pair.
    """
    pairs = saved(pairs.select("a", "b").distinct())
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")), texts)
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_TEXTS).cast("long").alias("salts"))
    dealt = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    members = dealt.select("b", "salt", F.col("a").alias("rep")).join(texts, "rep").withColumn("centre", F.lit(False))
    centres = (
        salts.select(F.col("b").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        .join(texts, "rep")
        .select("rep", F.col("rep").alias("b"), "salt", "text", F.lit(True).alias("centre"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [shingle_set(t, k) for t in pdf["text"][pdf["centre"]]]
        out = set()
        for rep, text in zip(pdf["rep"][~pdf["centre"]], pdf["text"][~pdf["centre"]]):
            s = shingle_set(text, k)
            for c in own:
                inter = len(c & s)
                if 100 * inter >= percent * (len(c) + len(s) - inter):
                    out.add(rep)
                    break
        return pd.DataFrame({"a": sorted(out), "b": int(pdf["b"].iat[0])}, dtype="int64")

    rows = members.select("b", "salt", "rep", "text", "centre").unionByName(
        centres.select("b", "salt", "rep", "text", "centre")
    )
    return rows.groupBy("b", "salt").applyInPandas(run, "a long, b long")


def _label(col: str, comps: DataFrame, name: str):
    """A column's component; a class without an edge is its own."""
    return comps.select(F.col("node").alias(col), F.col("label").alias(name))


def _with_labels(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    return (
        pairs.join(_label("a", comps, "_ca"), "a", "left")
        .join(_label("b", comps, "_cb"), "b", "left")
        .withColumn("ca", F.coalesce("_ca", "a"))
        .withColumn("cb", F.coalesce("_cb", "b"))
        .drop("_ca", "_cb")
    )


def _finish_buckets(buckets: DataFrame, comps: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components inside the buckets (``key, rep``) that hold several of them."""
    owned = buckets.join(_label("rep", comps, "_c"), "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")
    sized = owned.join(reps.select("rep", "n_shingles"), "rep")
    open_ = (
        sized.groupBy("key")
        .agg(
            F.min("comp").alias("lo"),
            F.max("comp").alias("hi"),
            F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("long").alias("blocks"),
        )
        .filter("lo < hi")
        .select("key", "blocks")
    )
    rows = saved(owned.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    # Each member meets every block of its bucket: task (i, j) with i <= j holds blocks i and j.
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key",
        "rep",
        "comp",
        "block",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
    )
    members = _texts_of(rows.select("rep"), texts)

    def sets(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"rep": pdf["rep"], "shingles": [shingle_hashes(words_of(t), k).tobytes() for t in pdf["text"]]})

    full = saved(members.mapInPandas(sets, "rep long, shingles binary"))
    both = dealt.join(reps.select("rep", "sig", "bands"), "rep").join(full, "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        rep, block = pdf["rep"].to_numpy(), pdf["block"].to_numpy()
        i, j, key = int(pdf["i"].iat[0]), int(pdf["j"].iat[0]), int(pdf["key"].iat[0])
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(-1, HASHES)
        bands = np.array(pdf["bands"].tolist(), dtype=np.int64).reshape(-1, BANDS)
        at = int(np.argmax((bands == key).any(axis=0)))
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
        sizes = np.array([len(s) for s in sets])
        comp = pdf["comp"].to_numpy().copy()
        out = []
        for x in range(len(rep) - 1):
            ys = np.arange(x + 1, len(rep))
            ok = (comp[ys] != comp[x]) & (np.minimum(sizes[ys], sizes[x]) * 100 >= np.maximum(sizes[ys], sizes[x]) * percent)
            if i != j:
                ok &= block[ys] != block[x]
            ys = ys[ok]
            if at and len(ys):  # the pair belongs to the first bucket that it shares
                ys = ys[~(bands[ys, :at] == bands[x, :at]).any(axis=1)]
            if not len(ys):
                continue
            m = sequential_matches(np.broadcast_to(sig[x], (len(ys), HASHES)), sig[ys], percent)
            for y in ys[np.argsort(-m, kind="stable")][: int((m >= 0).sum())]:
                if comp[y] == comp[x]:
                    continue  # joined meanwhile
                inter = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * inter >= percent * (sizes[x] + sizes[y] - inter):
                    out.append((rep[x], rep[y]))
                    comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    Texts are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of
    k-word shingles (a text with fewer words is one shingle, a null or empty text
    has none and is linked with nothing). ``component_id`` is the smallest id that
    links reach. ``doc_id`` is an integer; rows with a null id take no part, have no
    component and are kept. Repeated rows are copies with one id: all of them are
    kept or none. Classes of equal sets with the same smallest id count as one.
    An empty table gives no rows.
    """
    rows = saved(sketches(docs, k, id_col, text_col))
    named = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = saved(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").cast("long").alias("rep")))
    reps = saved(
        named.join(
            classes.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"]
        )
        .filter(F.col("doc_id") == F.col("rep"))
        .select("rep", "n_shingles", "sig", "bands")
        .dropDuplicates(["rep", "n_shingles"])
    )
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b < last").select("key", "b")
    buckets = saved(buckets.join(shared, "key"))
    star = buckets.filter(F.col("rep") != F.col("b")).select(F.col("rep").alias("a"), "b").distinct()
    likely = saved(_pruned(star, reps, percent))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))

    best = likely.groupBy("a").agg(F.max(F.struct("matches", (-F.col("b")).alias("nb"))).alias("m"))
    edges = saved(_verified(best.select("a", (-F.col("m.nb")).alias("b")), texts, k, percent))
    comps = connected_components(edges)
    rest = _with_labels(likely, comps).filter("ca <> cb").join(
        best.select("a", (-F.col("m.nb")).alias("b")), ["a", "b"], "left_anti"
    )
    rest = saved(rest.groupBy("ca", "cb", "a").agg(F.max(F.struct("matches", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    if not rest.isEmpty():
        edges = saved(edges.union(_verified(rest, texts, k, percent)))
        comps = connected_components(edges)
    more = saved(_finish_buckets(buckets.select("key", "rep"), comps, reps, texts, k, percent))
    if not more.isEmpty():
        comps = connected_components(edges.union(more))
    of_class = classes.join(_label("rep", comps, "label"), "rep", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("label", "rep").alias("component_id")
    )
    out = rows.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["f1", "f2", "n_shingles"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", F.col("doc_id").cast("long")))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


@query("op4_near_duplicates")
def op4(spark, sf_dir):
    """Whole ``documents`` texts, sets of 2-word shingles, links at a Jaccard similarity of 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)
