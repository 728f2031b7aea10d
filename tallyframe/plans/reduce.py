"""A bit filter of keys that drops rows without a partner before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 26  # the filter has a row per 64 bits, so at most 1,048,576 small rows


def bits_for(keys: int) -> int:
    """A power of two with about 16 bits a key: one row in 16 or fewer passes by chance, more beyond the largest size."""
    return min(max(1 << (BITS_PER_KEY * keys - 1).bit_length(), LEAST_BITS), MOST_BITS) if keys else LEAST_BITS


def _bit(key: str | Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits).cast("bigint"))


def key_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``(word, mask)``: 64 bits a row, set where a key's hash falls. Combined map-side; at most ``bits / 64`` rows."""
    at = keys.select(_bit(key, bits).alias("bit"))
    one = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    return at.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("mask"))


def keep_possible(df: DataFrame, key: str, words: DataFrame, bits: int) -> DataFrame:
    """Rows whose key may be among those of the filter: all that are, and few others.

    The filter is broadcast, its size is bounded by ``bits``; rows are tested where they are read.
    """
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits is too large to broadcast")
    marked = df.withColumn("_bit", _bit(key, bits)).withColumn("_word", F.floor(F.col("_bit") / 64))
    small = F.broadcast(words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask")))
    hit = F.getbit("_mask", (F.col("_bit") % 64).cast("int")) == 1
    return marked.join(small, "_word").where(hit).select(*df.columns)
