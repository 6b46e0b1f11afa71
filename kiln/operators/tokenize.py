"""Built-in vocabulary tokenizer and sequence packing.

T1: whitespace words, ids = 0-based dense rank of the word in a vocabulary
built from the corpus itself (an exact distributed row number). Rows are
dictionary-encoded by blocks: a block is a run of rows of bounded text size, whose
texts become the places of their words in the block's list of distinct words. These
lists get their ids by one join with the vocabulary (very common words, which stand
in every block, by a broadcast of their own), and each block's places are then
replaced by the ids of its list. Texts are split once, no row per token is shuffled,
and rows are matched by place, so null and repeated keys keep their ids.

T7: "concatenate and cut": per shard, documents are laid end to end in id
order and cut into blocks of ``max_length`` tokens. Each document's start
offset comes from a distributed running sum over (shard, id); a document then
yields one slice for each block it touches.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import checkpoint_dir
from .ranking import global_row_number
from .sizing import broadcast_if_small, join_on_nullable

#: Bytes of text in a block of rows (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
#: A word is common when it stands in more than this share of all (block, word) pairs; there are at most 1/share of them.
COMMON_SHARE = 1 / 2_000
_BLOCK = "_block"


def vocabulary(words: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words with ``token_id`` = 0-based rank in byte order."""
    v = words.select(word).distinct()
    return global_row_number(v, [word], out="_rn").select(word, (F.col("_rn") - 1).cast("int").alias("token_id"))


def with_blocks(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` written once, with ``_block``: runs of rows whose texts fill up to ``block_bytes``."""
    at = df.columns.index(text)

    def run(batches):
        block, held = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            out = np.empty(b.num_rows, np.int64)
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > block_bytes:
                    block, held = block + 1, 0
                held += n + 1
                out[i] = block
            yield b.append_column(_BLOCK, pa.array(out))

    checkpoint_dir(df.sparkSession)
    schema = StructType([*df.schema.fields]).add(_BLOCK, LongType())
    return df.mapInArrow(run, schema).checkpoint(eager=True)


def ids_of_words(pairs: DataFrame, vocab: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    """``(_block, word)`` pairs (materialized) with ``token_id``; null for a word outside the vocabulary.

    A vocabulary within the broadcast bound is broadcast. Beyond it the join
    shuffles, but for common words, whose number is bounded by their share of all
    pairs: they are joined by a broadcast, so that no task gets all blocks of a word.
    """
    bound = {} if max_broadcast_rows is None else {"max_rows": max_broadcast_rows}
    side, small = broadcast_if_small(vocab, **bound)
    if small:
        return pairs.join(side, "word", "left")
    least = pairs.count() * COMMON_SHARE
    common = pairs.groupBy("word").count().filter(F.col("count") > least).select("word").checkpoint(eager=True)
    known = vocab.join(F.broadcast(common), "word", "left_semi")
    often = pairs.join(F.broadcast(common), "word", "left_semi").join(F.broadcast(known), "word", "left")
    rest = pairs.join(F.broadcast(common), "word", "left_anti").join(vocab, "word", "left")
    return often.unionByName(rest)


def encoded_blocks(df: DataFrame, text: str, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts as numbers within their block, written once: ``keep``, ``_block``, ``_local`` and ``_words``.

    Blocks are those of :func:`with_blocks`. A row has in ``_local`` the places of
    its words among the distinct words of its block, which stand in ``_words`` of one
    further row for each block (its other columns are null).
    """
    at, kept = df.columns.index(text), [df.columns.index(c) for c in keep]
    places, strings = pa.list_(pa.int32()), pa.list_(pa.string())

    def numbering():  # gives each new key the next number
        number = defaultdict()
        number.default_factory = number.__len__
        return number

    def run(batches):
        block, held, number, types = TaskContext.get().partitionId() << 33, 0, numbering(), []
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
            blocks, ends, flat, ended = np.empty(b.num_rows, np.int64), np.zeros(b.num_rows + 1, np.int32), array("i"), []
            for i, (n, t) in enumerate(zip(sizes, b.column(at).to_pylist())):
                if held and held + n > block_bytes:
                    ended.append((block, list(number)))
                    block, held, number = block + 1, 0, numbering()
                held += n + 1
                blocks[i] = block
                if t:
                    flat.extend(map(number.__getitem__, t.split()))
                ends[i + 1] = len(flat)
            local = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            own = [b.column(i) for i in kept]
            types = [c.type for c in own]
            yield pa.RecordBatch.from_arrays([*own, pa.array(blocks), local, pa.nulls(b.num_rows, strings)], names=names)
            yield from (listed(types, *e) for e in ended)
        if held:
            yield listed(types, block, list(number))

    def listed(types, block, words):
        one = [*[pa.nulls(1, t) for t in types], pa.array([block]), pa.nulls(1, places), pa.array([words], strings)]
        return pa.RecordBatch.from_arrays(one, names=names)

    names = [*keep, _BLOCK, "_local", "_words"]
    schema = StructType([StructField(c, df.schema[c].dataType) for c in keep])
    schema = schema.add(_BLOCK, LongType()).add("_local", ArrayType(IntegerType())).add("_words", ArrayType(StringType()))
    checkpoint_dir(df.sparkSession)
    return df.mapInArrow(run, schema).checkpoint(eager=True)


def whitespace_vocabulary_ids(
    df: DataFrame,
    key: str,
    text: str,
    vocab: DataFrame | None = None,
    unknown_id: int | None = None,
    max_broadcast_rows: int | None = None,
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Return ``(df + input_ids, vocab)``; ids follow the word order of each text.

    Every row gets its own ids, whatever its ``key``; a null or empty text has
    none. A word outside a given vocabulary gets ``unknown_id``; without one it is
    an error. ``keep`` names the columns of ``df`` that are wanted (all, if unset):
    without the text, only numbers are written and shuffled.
    """
    kept = df.columns if keep is None else list(keep)
    coded = encoded_blocks(df, text, kept)
    words = coded.filter(F.col("_words").isNotNull()).select(_BLOCK, F.posexplode("_words").alias("_at", "word"))
    if vocab is None:
        vocab = vocabulary(words)
    unknown = F.lit(unknown_id) if unknown_id is not None else F.raise_error(F.lit("word outside the vocabulary")).cast("int")
    known = ids_of_words(words, vocab, max_broadcast_rows)
    known = known.select(F.col(_BLOCK).alias("_of"), "_at", F.coalesce("token_id", unknown).alias("token_id"))

    def look_up(block: pa.Table, ids: pa.Table) -> pa.Table:
        number = np.zeros(ids.num_rows, np.int32)
        number[ids.column("_at").to_numpy()] = ids.column("token_id").to_numpy()
        local = block.column("_local").combine_chunks()
        ends = np.zeros(len(local) + 1, np.int32)
        np.cumsum(pc.list_value_length(local).to_numpy(zero_copy_only=False), out=ends[1:])
        found = number[pc.list_flatten(local).to_numpy(zero_copy_only=False)]
        out = pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.int32()))
        return pa.Table.from_arrays([*[block.column(c) for c in kept], out], names=[*kept, "input_ids"])

    schema = StructType([df.schema[c] for c in kept]).add("input_ids", ArrayType(IntegerType()))
    rows = coded.filter(F.col("_words").isNull()).drop("_words")
    return rows.groupBy(_BLOCK).cogroup(known.groupBy("_of")).applyInArrow(look_up, schema), vocab


def tokenizer_hook(fn: Callable[[Column], Column]) -> Callable[[DataFrame, str, str], DataFrame]:
    """Wrap a ``Column -> array<int>`` tokenizer (e.g. a pandas UDF) as a DataFrame step."""

    def apply(df: DataFrame, text: str, out: str = "input_ids") -> DataFrame:
        return df.withColumn(out, fn(F.col(text)))

    return apply


def running_offsets(df: DataFrame, shard: str, order: str, length: str, out: str = "offset") -> DataFrame:
    """Start offset of each row = sum of ``length`` over earlier rows of its shard.

    A global running sum over (shard, order) is computed without a
    single-partition window (see :func:`global_prefix_sum`); the shard's base
    is then subtracted, so a shard holding a third of the rows is still
    spread over many tasks.
    """
    cum = global_prefix_sum(df, [shard, order], length, out="_cum")
    base = cum.groupBy(shard).agg(F.min(F.col("_cum") - F.col(length)).alias("_base"))
    return (
        join_on_nullable(cum, base, [shard])
        .withColumn(out, F.col("_cum") - F.col(length) - F.col("_base"))
        .drop("_cum", "_base")
    )


def global_prefix_sum(df: DataFrame, order: list[str], value: str, out: str = "cumsum") -> DataFrame:
    """Inclusive running sum of ``value`` in the total order of ``order`` (distributed).

    Range partitions are written once with ``checkpoint()`` (their bounds are
    sampled), per-partition totals go to the driver (one number per
    partition), and each partition adds its base to a local running sum.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    totals = dict(ranged.groupBy("_pid").agg(F.sum(value)).collect())
    base, acc = [], 0
    for p in range(n):
        base.append(acc)
        acc += totals.get(p) or 0
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off = F.element_at(F.array(*[F.lit(b).cast("long") for b in base]), F.col("_pid") + 1)
    return ranged.withColumn(out, F.sum(value).over(w) + off).drop("_pid")


def pack_blocks(
    df: DataFrame, shard: str, order: str, ids: str = "input_ids", max_length: int = 2048
) -> DataFrame:
    """Concatenate token ids per shard in ``order`` and cut into ``max_length`` blocks.

    Output: ``shard, block, input_ids`` (each block ≤ ``max_length`` tokens). A
    document from offset ``a`` to ``b`` gives the slices ``[a, b) ∩ [kL, (k+1)L)``, one
    for each block ``k`` it touches; a block gathers at most ``max_length`` tokens.
    A null shard is a shard; rows equal in (shard, order) stand in any order.
    """
    size = F.lit(max_length).cast("long")
    rows = df.select(shard, order, F.col(ids).alias("_ids")).withColumn("_len", F.coalesce(F.size("_ids"), F.lit(0)).cast("long"))
    placed = running_offsets(rows.filter("_len > 0"), shard, order, "_len", out="_off")

    def piece(k: Column) -> Column:
        begin = F.greatest(k * size, F.col("_off"))
        end = F.least((k + 1) * size, F.col("_off") + F.col("_len"))
        cut = F.slice("_ids", (begin - F.col("_off") + 1).cast("int"), (end - begin).cast("int"))
        return F.struct(k.alias("block"), begin.alias("at"), cut.alias("ids"))

    touched = F.sequence(F.expr(f"_off DIV {max_length}"), F.expr(f"(_off + _len - 1) DIV {max_length}"))
    slices = placed.select(shard, F.explode(F.transform(touched, piece)).alias("s")).select(shard, "s.*")
    packed = slices.groupBy(shard, "block").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("_s"))
    return packed.select(shard, "block", F.flatten(F.transform("_s", lambda s: s["ids"])).alias("input_ids"))
