"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is a character n-gram model of trusted documents (labelled good and not
toxic). All counting, continuation counts, discounts, back-off weights and the
interpolation are joins and aggregates over n-gram tables. Scoring looks up every
position of every text by shards: the table is cut by the two characters before a
position, so each position finds all its orders in one shard. A shard goes through
the driver and is broadcast by itself, one at a time, and the partial sums are added
up. ``SHARD_ROWS`` is a shard's mean size: a frequent pair of characters is not split,
and 1- and 2-grams stand in every shard.

The cutoff is out of sample: trusted texts fall by hash into ``FOLDS`` folds, each
scored by the model of the others, and a document is kept if its perplexity under the
model of all trusted documents is at most its language's ``QUANTILE`` of those scores.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, read, saved

ORDER = 5
PAD = "\x02"
#: Model rows (n-grams and contexts) of one shard; the table is cut into as many shards as it needs.
SHARD_ROWS = 2_000_000
#: Rows of a partition of the model's tables at least: fewer files than shuffle partitions where the tables are small.
PART_ROWS = 100_000
QUANTILE = 0.99
FOLDS = 2
_SLICE = 256
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def plain(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().replace(PAD, " ").split())


def codes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ``ORDER - 1`` pads, and the index of each character's text."""
    padded = [PAD * (ORDER - 1) + plain(t) for t in texts]
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes, np.repeat(np.arange(len(padded)), lengths)


def suffix_keys(codes: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER the keys of the n-grams that end at each place (rubbish where they'd start before 0)."""
    c = codes.astype(np.uint64)
    keys = [_mix(c * _MUL + np.uint64(1))]
    for n in range(1, ORDER):
        back = np.zeros_like(c)
        back[n:] = c[:-n]
        keys.append(_mix((keys[-1] + back) * _MUL + np.uint64(n + 1)))
    return keys


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, c``: the ORDER-grams of all texts with their counts."""

    def run(pdfs):
        for pdf in pdfs:
            for i in range(0, len(pdf), _SLICE):
                codes, _ = codes_of(pdf["text"].iloc[i : i + _SLICE])
                keys = suffix_keys(codes)[-1]
                use = np.flatnonzero(codes != ord(PAD))
                if not len(use):
                    continue
                _, first, c = np.unique(keys[use], return_index=True, return_counts=True)
                ends = use[first]
                grams = codes[ends[:, None] + np.arange(1 - ORDER, 1)[None, :]]
                text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield pd.DataFrame({"gram": [text[j : j + ORDER] for j in range(0, len(text), ORDER)], "c": c})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "gram string, c long")
    return rows.groupBy("gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``n, gram, logp`` of all orders and, as ``n = -len``, ``logp`` = log back-off weight of contexts."""
    counts = saved(counts)
    rows = {ORDER: counts.count()}
    few = {ORDER: -(-rows[ORDER] // PART_ROWS) or 1}
    tables = {ORDER: counts.coalesce(few[ORDER])}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before
        shorter = tables[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        tables[n] = saved(shorter.coalesce(few[n + 1]))
        rows[n] = tables[n].count()
        few[n] = -(-rows[n] // PART_ROWS) or 1
        tables[n] = tables[n].coalesce(few[n])
    vocabulary = rows[1] + 1
    parts, lower = [], None
    for n in range(1, ORDER + 1):
        t = tables[n]
        n1, n2, n3, n4 = (x or 0 for x in t.agg(*[F.sum(F.when(F.col("c") == i, 1)) for i in range(1, 5)]).first())
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        bound = lambda d, most: min(max(d, 0.05), most - 0.05)
        d1 = bound(1 - 2 * y * n2 / n1 if n1 else 0.5, 1)
        d2 = bound(2 - 3 * y * n3 / n2 if n2 else 1.0, 2)
        d3 = bound(3 - 4 * y * n4 / n3 if n3 else 1.5, 3)
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        t = t.select("gram", "c", off.alias("off"), F.substring("gram", 1, n - 1).alias("ctx"))
        ctx = t.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("gamma"))
        ctx = saved(ctx.coalesce(few[n]))
        t = t.join(ctx.hint("merge"), "ctx")  # both sides grow with the input: never broadcast
        if lower is None:
            t = t.withColumn("low", F.lit(1.0 / vocabulary))
        else:
            t = t.join(lower.hint("merge"), F.substring(F.col("gram"), 2, n - 1) == F.col("low_gram"))
        p = (F.col("c") - F.col("off")) / F.col("total") + F.col("gamma") * F.col("low")
        own = saved(t.select("gram", p.alias("p")).coalesce(few[n]))
        parts.append(own.select(F.lit(n).alias("n"), "gram", F.log("p").alias("logp")))
        parts.append(ctx.select(F.lit(1 - n).alias("n"), F.col("ctx").alias("gram"), F.log("gamma").alias("logp")))
        lower = own.select(F.col("gram").alias("low_gram"), F.col("p").alias("low"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    unknown = counts.sparkSession.createDataFrame([(0, PAD, -float(np.log(vocabulary)))], "n int, gram string, logp double")
    return out.unionByName(unknown.coalesce(1))


def _pair_shard(before2: np.ndarray, before1: np.ndarray, shards: int) -> np.ndarray:
    return _mix(before2.astype(np.uint64) * _MUL + before1.astype(np.uint64)) % np.uint64(shards)


def keyed(model: DataFrame, shards: int) -> DataFrame:
    """``n, key, logp, shard``: keys as :func:`suffix_keys` makes them; shard -1 stands in every shard."""

    def run(pdfs):
        for pdf in pdfs:
            for n, part in pdf.groupby("n", sort=False):
                size = abs(int(n))
                if size == 0:
                    unknown = part["gram"] == PAD
                    yield part.assign(key=np.where(unknown, 1, 0), shard=-1)[["n", "key", "logp", "shard"]]
                    continue
                codes = np.frombuffer("".join(part["gram"]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, size)
                key = suffix_keys(codes.reshape(-1))[size - 1].reshape(-1, size)[:, -1].view(np.int64)
                end = size - 1 if n > 0 else size  # the context ends here
                shard = (
                    _pair_shard(codes[:, end - 2], codes[:, end - 1], shards).astype(np.int64) if end >= 2 else np.full(len(part), -1)
                )
                yield part.assign(key=key, shard=shard)[["n", "key", "logp", "shard"]]

    return model.mapInPandas(run, "n int, key long, logp double, shard long")


class Lookup:
    """A sorted key table; the leading bits of a key tell where its search begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.start = np.searchsorted(self.keys, edges).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(found, value)``"""
        at = self.start[(keys >> self.shift).astype(np.int64)]
        last = len(self.keys) - 1
        if last < 0:
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
        np.minimum(at, last, out=at)
        low = np.flatnonzero(self.keys[at] < keys)
        while len(low):
            at[low] += 1
            low = low[at[low] <= last]
            low = low[self.keys[at[low]] < keys[low]]
        np.minimum(at, last, out=at)
        return self.keys[at] == keys, self.values[at]


def packed(table: DataFrame) -> DataFrame:
    """``n, keys, values``: the rows of ``keyed`` as little-endian arrays, 12 bytes a row, some for each batch."""

    def run(pdfs):
        for pdf in pdfs:
            for n, part in pdf.groupby("n", sort=False):
                keys, values = part["key"].to_numpy("<i8"), part["logp"].to_numpy("<f4")
                yield pd.DataFrame({"n": [n], "keys": [keys.tobytes()], "values": [values.tobytes()]})

    return table.select("n", "key", "logp").mapInPandas(run, "n int, keys binary, values binary")


def unpacked(rows) -> tuple[dict[int, Lookup], float, float]:
    """Lookups of all orders, the back-off weight of the empty context and the unknown character's log probability."""
    parts: dict[int, tuple[list, list]] = {n: ([], []) for n in range(1 - ORDER, ORDER + 1)}
    for n, keys, values in rows:
        parts[n][0].append(np.frombuffer(keys, dtype="<i8"))
        parts[n][1].append(np.frombuffer(values, dtype="<f4"))
    whole = {
        n: (np.concatenate([*k, np.empty(0, dtype=np.int64)]), np.concatenate([*v, np.empty(0, dtype=np.float32)]))
        for n, (k, v) in parts.items()
    }
    keys, values = whole.pop(0)
    return {n: Lookup(k, v) for n, (k, v) in whole.items()}, float(values[keys == 0].sum()), float(values[keys == 1].sum())


def score_texts(texts, tables: dict[int, Lookup], unknown: float, gamma0: float, shard: int, shards: int):
    """``(log probability, characters)`` of each text, over the positions of this shard."""
    codes, owner = codes_of(texts)
    if not len(codes):
        return np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    keys = suffix_keys(codes)
    use = np.flatnonzero(codes != ord(PAD))
    if shards > 1:
        use = use[_pair_shard(codes[use - 2], codes[use - 1], shards) == shard]
    logp = np.zeros(len(use))
    left = np.arange(len(use))
    for n in range(ORDER, 0, -1):
        at = use[left]
        found, value = tables[n].find(keys[n - 1][at])
        logp[left[found]] += value[found]
        left = left[~found]
        if not len(left):
            break
        if n > 1:
            seen, weight = tables[1 - n].find(keys[n - 2][use[left] - 1])
            logp[left[seen]] += weight[seen]
    logp[left] += gamma0 + unknown
    return (
        np.bincount(owner[use], weights=logp, minlength=len(texts)),
        np.bincount(owner[use], minlength=len(texts)),
    )


def score_documents(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang, n_chars, log_perplexity`` (null without characters), a row for each row."""
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // SHARD_ROWS))
    table = saved(keyed(model, shards))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("doc_id", F.col("doc_id").cast("string"))
    passes = None
    for shard in range(shards):
        sent = spark.sparkContext.broadcast(
            [tuple(r) for r in packed(table.filter(F.col("shard").isin(-1, shard))).collect()]
        )

        def run(pdfs, sent=sent, shard=shard):
            tables, gamma0, unknown = unpacked(sent.value)
            for pdf in pdfs:
                for i in range(0, len(pdf), _SLICE):
                    part = pdf.iloc[i : i + _SLICE]
                    logp, chars = score_texts(part["text"], tables, unknown, gamma0, shard, shards)
                    yield part[["doc_id", "lang", "text_hash"]].assign(logp=logp, chars=chars)

        one = saved(rows.mapInPandas(run, "doc_id string, lang string, text_hash long, logp double, chars long"))
        sent.destroy()  # driver and executors hold one shard at a time
        passes = one if passes is None else passes.unionByName(one)
    if shards > 1:  # equal rows share their sums
        passes = (
            passes.groupBy("doc_id", "lang", "text_hash")
            .agg(F.sum("logp").alias("logp"), F.sum("chars").alias("chars"), (F.count(F.lit(1)) / shards).cast("long").alias("m"))
            .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
            .withColumn("logp", F.col("logp") / F.col("m"))
            .withColumn("chars", (F.col("chars") / F.col("m")).cast("long"))
        )
    return passes.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        "lang",
        F.col("chars").alias("n_chars"),
        F.when(F.col("chars") > 0, -F.col("logp") / F.col("chars")).alias("log_perplexity"),
    )


def language_cutoffs(trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang, cutoff``: the quantile of log perplexity over trusted documents, in steps of 0.001.

    The row with ``pooled`` true is over all languages, for those without trusted text.
    """
    bins = trusted.filter(F.col("log_perplexity").isNotNull()).select(
        "lang", F.floor(F.col("log_perplexity") * 1000).cast("long").alias("bin")
    )
    both = bins.withColumn("pooled", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "lang", F.when(F.col("pooled"), F.lit(None)).otherwise(F.col("lang"))
    )
    counts = both.groupBy("pooled", "lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy("pooled", "lang")
    run = counts.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("all", F.sum("n").over(part))
    cut = F.min(F.when(F.col("upto") >= F.col("all") * quantile, F.col("bin")))
    return run.groupBy("pooled", "lang").agg(((cut + 1) / 1000).alias("cutoff"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, cutoff, kept``.

    Trusted text: documents with a label of quality 1 that is not toxic. A null or
    blank text has no perplexity and is not kept; a null language is one of its
    own; languages without trusted text use the cutoff over all trusted documents;
    without any trusted document every text is kept. Equal texts share a fold; if all
    trusted texts fall into one, as a single one must, their cutoff is in sample.
    ``doc_id`` is an integer; repeated rows are judged each; null ids are never trusted.
    """
    ids = saved(labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct())
    trusted = docs.join(F.broadcast(ids) if _small(ids) else ids, "doc_id", "left_semi")
    scored = saved(score_documents(docs, saved(kneser_ney(count_grams(trusted)))))
    cutoffs = saved(language_cutoffs(_out_of_sample(trusted, scored, ids)))
    own = cutoffs.filter(~F.col("pooled")).select(F.col("lang").alias("_lang"), "cutoff")
    pooled = cutoffs.filter("pooled").first()
    joined = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    cutoff = F.coalesce(F.col("cutoff"), F.lit(pooled["cutoff"] if pooled else float("inf")))
    return joined.select(
        "doc_id",
        "lang",
        "n_chars",
        F.round(F.exp("log_perplexity"), 6).alias("perplexity"),
        F.round(F.exp(cutoff), 6).alias("cutoff"),
        F.coalesce(F.col("log_perplexity") <= cutoff, F.lit(False)).alias("kept"),
    )


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(text, F.lit(""))), F.lit(FOLDS))


def _out_of_sample(trusted: DataFrame, scored: DataFrame, ids: DataFrame) -> DataFrame:
    """``scored`` of the trusted documents, each fold by the model of the others."""
    fold = fold_of(F.col("text"))
    if trusted.select(fold.alias("fold")).distinct().count() < 2:
        return scored.join(ids, "doc_id", "left_semi")
    parts = [
        saved(score_documents(trusted.filter(fold == f), saved(kneser_ney(count_grams(trusted.filter(fold != f))))))
        for f in range(FOLDS)
    ]
    return reduce(DataFrame.unionByName, parts)


def _small(ids: DataFrame) -> bool:
    return ids.count() <= 2_000_000


@query("op3_perplexity")
def op3(spark, sf_dir):
    """Every whole text of ``documents`` scored by the model of its trusted documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, read(spark, sf_dir, "labels"))
