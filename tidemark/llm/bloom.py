"""A blocked Bloom filter as a table, probed by one broadcast lookup and one mask test.

The filter is a table of 64-bit blocks: a key hashes to one block and to a few bits in it.
Its size has a fixed bound.  Beyond it the filter keeps that size, sets fewer bits a key and
lets more keys pass; what follows it must be exact anyway.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MOST_HASHES = 6
#: Bytes that a block takes in a broadcast hash table.
BLOCK_BYTES = 32


@dataclass(frozen=True)
class Shape:
    """Number of blocks, and bits a key."""

    blocks: int
    hashes: int

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    def mask(self, key: Column) -> Column:
        h = F.xxhash64(F.lit("bits"), key)
        mask = F.lit(0).cast("long")
        for i in range(self.hashes):
            bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return mask


def shape(n_keys: int, max_bytes: int = 64 << 20) -> Shape:
    """The shape for ``n_keys`` keys within ``max_bytes``."""
    blocks = max(64, min(-(-n_keys * BITS_PER_KEY // 64), max_bytes // BLOCK_BYTES))
    return Shape(blocks, max(1, min(MOST_HASHES, round(0.69 * 64 * blocks / max(1, n_keys)))))


def possible(rows: DataFrame, keys: DataFrame, key: str, of: Shape) -> DataFrame:
    """``rows`` with a column ``maybe``: whether ``rows[key]`` may be among ``keys[key]``.  Null keys are not."""
    own = F.col(key)
    table = keys.groupBy(of.block(own).alias("__block")).agg(F.bit_or(of.mask(own)).alias("__word"))
    probed = rows.withColumn("__block", of.block(own)).join(F.broadcast(table), "__block", "left")
    mask = of.mask(own)
    maybe = F.coalesce(F.col("__word").bitwiseAND(mask) == mask, F.lit(False)) & own.isNotNull()
    return probed.withColumn("maybe", maybe).drop("__block", "__word")
