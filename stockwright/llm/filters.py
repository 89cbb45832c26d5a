"""Bitmaps of hashed keys: which rows may have a key of a set, told without an
exchange of the rows.

A bitmap has ``BITS`` bits for every key of the set, whose size is counted. One
of up to ``BOUND`` bytes is broadcast; with a larger one callers take an ordinary
join instead. Either way the result is exact, as callers check what passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name

#: Bits for each key; bits of one row of the bitmap.
BITS, WORD = 16, 15
#: Bytes of the largest bitmap that is broadcast.
BOUND = 64 << 20


@dataclass
class Filter:
    """A bitmap over hashed digests: (word, bits of 2^WORD places)."""

    bits: DataFrame
    power: int

    @property
    def bounded(self) -> bool:
        return (1 << self.power) <= 8 * BOUND

    def mark(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (with a column digest) and whether the filter has each digest;
        wrong only for digests that it does not have, and then seldom true."""
        place = F.xxhash64("digest").bitwiseAND(F.lit((1 << self.power) - 1))
        own = free_name("word_", [*rows.columns, "bits"])
        bits = self.bits.select(F.col("word").alias(own), F.col("bits").alias(f"{own}bits"))
        bits = F.broadcast(bits) if self.bounded else bits
        out = rows.withColumn(own, F.shiftright(place, WORD)).join(bits, own, "left")
        at = place.bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"{own}bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
        return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop(own, f"{own}bits")


def make_filter(scratch: Scratch, entries: DataFrame, n: int) -> Filter:
    """The filter of n entries' digests."""
    power = max(WORD, (BITS * n).bit_length())
    place = F.xxhash64("digest").bitwiseAND(F.lit((1 << power) - 1))
    bits = entries.select(F.shiftright(place, WORD).alias("word"), place.bitwiseAND(F.lit((1 << WORD) - 1)).alias("bit"))
    return Filter(scratch.keep(bits.groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter"), power)


def candidates(scratch: Scratch, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose digest may be among keys (digest), missing none of them;
    exactly those where the bitmap would be too large."""
    found = make_filter(scratch, keys, keys.count())
    if found.bounded:
        return found.mark(rows, "_may").where("_may").drop("_may")
    return rows.join(keys.distinct(), "digest", "left_semi")
