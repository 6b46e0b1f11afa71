"""Benchmark decontamination and exact dedup.

Plan shape (no shuffle of the corpus text):

1. benchmark texts and corpus rows → 8-byte hashes of their 8-grams (each word
   hashed once, a gram's hash is that of its words' hashes); the corpus hashes are
   semi-joined with the benchmarks', broadcast within the measured bound;
2. the grams with a hit (few) → strings, on both sides, joined: exact
   confirmation. No other gram is ever written or shuffled as a string;
3. flags per text digest = left join of the corpus, broadcast after a count when
   few texts are hit.

Above the bound, a Bloom filter of the benchmarks' hashes (at most 64 MB) is
broadcast and probed in the scan's stage, and only the hashes that pass it are
shuffled. Texts, not ids, are what is flagged, so null and repeated ids are
judged each by their own text.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, split_words, word_ngrams
from ..session import checkpoint_dir
from .bloom import BloomFilter
from .sizing import DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_small, measured_join

FLAG_PREFIX = "contaminated_"


def ngram_set(df: DataFrame, text: str, n: int) -> DataFrame:
    """Rows → distinct n-gram strings of the normalised text (column ``ngram``)."""
    words = df.select(split_words(text, lower=True).alias("_w"))
    return words.select(F.explode(F.array_distinct(word_ngrams("_w", n))).alias("ngram")).distinct()


def benchmark_ngrams(benchmarks: Mapping[str, tuple[DataFrame, str]], n: int = 8) -> DataFrame:
    """Union of the benchmarks' distinct n-grams, tagged ``(ngram, benchmark)``."""
    parts = [ngram_set(df, col, n).withColumn("benchmark", F.lit(name)) for name, (df, col) in benchmarks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _placed_grams(words: DataFrame, n: int) -> DataFrame:
    """``_w`` (words) → one row for each n-gram with its place ``_i`` (0-based) and hash ``_h``; all columns stay."""
    hashed = words.filter(F.size("_w") >= n).select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"))
    # Positions are exploded, not grams: the hash of each gram is then part of the generated code.
    placed = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("_wh") - F.lit(n))).alias("_i"))
    return placed.withColumn("_h", F.xxhash64(*[F.get("_wh", F.col("_i") + k) for k in range(n)])).drop("_wh")


def _gram_hashes(words: DataFrame, n: int) -> DataFrame:
    """``_w`` (words) → one row ``_h`` for each n-gram; all other columns stay."""
    return _placed_grams(words, n).drop("_w", "_i")


def _maybe_in(grams: DataFrame, members: DataFrame, max_broadcast_rows: int) -> tuple[DataFrame, bool]:
    """The rows of ``grams`` whose ``_h`` is (or, above the bound, may be) in ``members``, and whether that is exact.

    No row of ``grams`` is shuffled: the members (materialized, distinct) are
    broadcast within the bound, above it their Bloom filter is.
    """
    probe, small = broadcast_if_small(members, max_broadcast_rows)
    if small:
        return grams.join(probe, "_h", "left_semi"), True
    return BloomFilter(members, "_h").maybe_in(grams, "_h"), False


def probe_hashes(grams: DataFrame, members: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """The rows of ``grams`` whose ``_h`` is in ``members`` (materialized, distinct).

    Within the bound the members are broadcast; above it their Bloom filter is,
    and what passes is joined by a shuffle.
    """
    near, exact = _maybe_in(grams, members, max_broadcast_rows)
    # No semi-join here: Spark would move it below the filter's join and shuffle all grams. The members are distinct.
    return near if exact else near.join(members, "_h").select(*grams.columns)


def _shared_grams(words: DataFrame, shared: DataFrame, n: int, max_broadcast_rows: int) -> DataFrame:
    """``_w`` (words) → distinct rows with the string ``ngram`` of each n-gram whose hash may be in ``shared``."""
    near, _ = _maybe_in(_placed_grams(words, n), shared, max_broadcast_rows)
    rest = [c for c in words.columns if c != "_w"]
    return near.select(*rest, F.array_join(F.slice("_w", F.col("_i") + 1, n), " ").alias("ngram")).distinct()


def _contaminated(corpus: DataFrame, text: str, bench: DataFrame, n: int, max_broadcast_rows: int) -> DataFrame:
    """Distinct ``(_t, benchmark)`` as in :func:`contaminated_texts`; ``bench`` has rows ``(_w, benchmark)`` of words."""
    checkpoint_dir(corpus.sparkSession)
    members = _gram_hashes(bench.select("_w"), n).distinct().checkpoint(eager=True)
    # Eight bytes stand for a text here; what they confuse the strings tell apart.
    words = corpus.select(F.xxhash64(text).alias("_id"), split_words(text, lower=True).alias("_w"))
    pairs = probe_hashes(_gram_hashes(words, n), members, max_broadcast_rows).distinct().checkpoint(eager=True)
    shared = pairs.select("_h").distinct().checkpoint(eager=True)
    texts = corpus.select(F.xxhash64(text).alias("_id"), F.col(text).alias("_text"))
    candidates = measured_join(texts, pairs.select("_id").distinct(), "_id", "left_semi")
    words = candidates.select(F.md5("_text").alias("_t"), split_words("_text", lower=True).alias("_w"))
    side = _shared_grams(bench, shared, n, max_broadcast_rows).checkpoint(eager=True)
    side, _ = broadcast_if_small(side, max_broadcast_rows)
    return _shared_grams(words, shared, n, max_broadcast_rows).join(side, "ngram").select("_t", "benchmark").distinct()


def contaminated_texts(
    corpus: DataFrame,
    text: str,
    bench_grams: DataFrame,
    n: int = 8,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Distinct ``(_t, benchmark)``: md5 of each text that shares an n-gram with a benchmark.

    Texts are probed by 8-byte n-gram hashes. The n-grams with a hit (few), and no
    others, are then confirmed as strings, so the result is exact.
    """
    bench = bench_grams.select(F.split("ngram", " ").alias("_w"), "benchmark")
    return _contaminated(corpus, text, bench, n, max_broadcast_rows)


def contamination_hits(
    corpus: DataFrame,
    key: str,
    text: str,
    bench_grams: DataFrame,
    n: int = 8,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Distinct ``(key, benchmark)`` of the rows whose text shares an n-gram with a benchmark."""
    hits = contaminated_texts(corpus, text, bench_grams, n, max_broadcast_rows)
    keyed = corpus.select(key, F.md5(text).alias("_t"))
    return measured_join(keyed, hits, "_t").select(key, "benchmark").distinct()


def decontaminate(
    corpus: DataFrame,
    benchmarks: Mapping[str, tuple[DataFrame, str]],
    key: str,
    text: str,
    n: int = 8,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Add one boolean ``contaminated_<name>`` column per benchmark.

    A row is judged by its text alone, whatever its ``key``; a null text has no n-gram.
    """
    names = list(benchmarks)
    words = [df.select(split_words(col, lower=True).alias("_w"), F.lit(nm).alias("benchmark")) for nm, (df, col) in benchmarks.items()]
    hits = _contaminated(corpus, text, reduce(DataFrame.unionByName, words), n, max_broadcast_rows)
    flags = hits.groupBy("_t").agg(
        *[F.max(F.col("benchmark") == F.lit(nm)).alias(FLAG_PREFIX + nm) for nm in names]
    )
    # Only contaminated texts have a flag row; when they are few (counted) the
    # flags are broadcast and the corpus is joined without being shuffled.
    flags = flags.checkpoint(eager=True)
    flags, _ = broadcast_if_small(flags, max_broadcast_rows)
    out = corpus.join(flags, F.md5(text) == F.col("_t"), "left").drop("_t")
    for nm in names:
        out = out.withColumn(FLAG_PREFIX + nm, F.coalesce(F.col(FLAG_PREFIX + nm), F.lit(False)))
    return out


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(FLAG_PREFIX)]


def cleanup(flagged: DataFrame) -> DataFrame:
    """Drop flagged rows, then every ``contaminated_*`` column."""
    cols = flag_columns(flagged)
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~F.col(c)
    return flagged.filter(cond).drop(*cols)


def removal_counts(flagged: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows removed per benchmark in cleaning order (first hit counts)."""
    cols = order or flag_columns(flagged)
    first = None
    for c in cols:
        name = F.lit(c[len(FLAG_PREFIX):])
        first = F.when(F.col(c), name) if first is None else first.when(F.col(c), name)
    return (
        flagged.select(first.alias("benchmark"))
        .filter(F.col("benchmark").isNotNull())
        .groupBy("benchmark")
        .agg(F.count(F.lit(1)).alias("removed"))
    )


def exact_dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per normalised text, that of the smallest key (a null key is the largest).

    NULL texts are equal to each other. Only counts per ``(md5 of the normalised
    text, key)`` are shuffled; a text repeated by a third of all rows shrinks to
    its keys per task before that. The texts that stand more than once are written
    and, if few (measured), broadcast to the scan, which drops all other keys'
    rows. Rows that agree on text and key (repeated rows, null keys) are reduced
    to one in a branch of their own.
    """
    digest = F.coalesce(F.md5(normalize_text(text)), F.lit(""))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    per_key = df.select(digest.alias("_h"), key).groupBy("_h", key).agg(F.count(F.lit(1)).alias("_n"))
    first = per_key.groupBy("_h").agg(F.sum("_n").alias("_rows"), F.min(F.struct(order.alias("o"), "_n")).alias("_m"))
    repeated = first.filter("_rows > 1").select("_h", F.col("_m.o.key").alias("_key"), (F.col("_m._n") > 1).alias("_tied"))
    checkpoint_dir(df.sparkSession)
    repeated = repeated.checkpoint(eager=True)
    side, _ = broadcast_if_small(repeated)
    marked = df.withColumn("_h", digest).join(side, "_h", "left")
    kept = marked.filter(F.col("_tied").isNull() | F.col(key).eqNullSafe(F.col("_key")))
    if repeated.filter("_tied").isEmpty():
        return kept.select(*df.columns)
    plain = kept.filter(~F.coalesce("_tied", F.lit(False))).select(*df.columns)
    return plain.unionByName(kept.filter("_tied").dropDuplicates(["_h"]).select(*df.columns))


def resume_pending(todo: DataFrame, done: DataFrame, todo_id: str, done_id: str) -> DataFrame:
    """Rows whose ``md5(str(id))`` is not yet in the finished output."""
    done_keys = done.select(F.md5(F.col(done_id).cast("string")).alias("_k")).distinct()
    keyed = todo.withColumn("_k", F.md5(F.col(todo_id).cast("string")))
    return measured_join(keyed, done_keys, "_k", "left_anti").drop("_k")
