"""A blocked Bloom filter as a DataFrame: built by ``bit_or``, probed by a broadcast join.

Each 64-bit hash belongs to one block of 32,768 bits and sets three bits there,
all taken from the hash itself. The blocks are rows ``block, words`` (512 longs),
at most :data:`MAX_BLOCKS` of them (64 MB), so they may always be broadcast: the
probe runs in the stage that makes the hashes, and what passes is a superset of
the true members. Beyond the capacity more passes, nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
WORDS = BLOCK_BITS // 64
MAX_BLOCKS = 16_384
BITS_PER_KEY = 24
_PROBES, _STEP = 3, 15


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, _PROBES * _STEP).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _place(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, i * _STEP).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")


class BloomFilter:
    """Filter over the long column ``col`` of ``hashes`` (which the caller has materialized)."""

    def __init__(self, hashes: DataFrame, col: str, max_blocks: int = MAX_BLOCKS):
        n, self.blocks = hashes.count(), 1
        while self.blocks < max_blocks and self.blocks * BLOCK_BITS < n * BITS_PER_KEY:
            self.blocks *= 2
        h = F.col(col)
        # Dealt out by block once, as hashes: the words of a block are then made where its hashes are.
        dealt = hashes.select(_block(h, self.blocks).alias("block"), h.alias(col)).repartition("block")
        places = dealt.select(
            "block", F.explode(F.array(*[_place(h, i) for i in range(_PROBES)])).alias("at")
        )
        at = F.col("at")
        words = places.groupBy("block", F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
        words = words.select((F.col("block") * WORDS + F.col("word")).cast("long").alias("id"), "bits")
        every = hashes.sparkSession.range(self.blocks * WORDS).join(words, "id", "left")
        listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        self.table = every.groupBy(F.floor(F.col("id") / WORDS).cast("int").alias("_block")).agg(listed.alias("_l")).select(
            "_block", F.col("_l.bits").alias("_words")
        )

    def maybe_in(self, df: DataFrame, col: str) -> DataFrame:
        """The rows of ``df`` whose hash may be a member (columns as before)."""
        h, found = F.col(col), F.lit(True)
        for i in range(_PROBES):
            at = _place(h, i)
            word = F.get(F.col("_words"), F.shiftright(at, 6))
            bit = F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)))
            found = found & (bit.bitwiseAND(F.lit(1)) == 1)
        near = df.join(F.broadcast(self.table), _block(h, self.blocks) == F.col("_block"))
        return near.filter(found).select(*df.columns)
