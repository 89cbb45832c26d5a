"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (record key, shard) pair has a hash u in (0, 1); the record goes to the
shard with the greatest weight / -ln(u). A shard wins in proportion to its
weight, and a pair's score never depends on the other shards: one more shard
takes rows only into itself, one shard less moves only its own rows.

A record's slot in its shard is its rank by (doc_id, text_crc32), found without
gathering a shard (see ``common.ranks``).

Null keys are one key. Rows with one key go to one shard, whatever their text;
a null text has no bytes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranks

SHARDS = 8
LAW = "key"


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a record key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    # 53 bits of the hash, moved off both ends of the unit interval
    unit = lambda j: (F.shiftrightunsigned(F.xxhash64(name, F.lit(j)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    scores = [F.struct((F.lit(float(w)) / -F.ln(unit(j))).alias("score"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot and
    grown_shard (with one more shard of the last one's weight)."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, weights[-1]]).alias("grown_shard"),
    )
    return ranks(scratch, scratch.keep(rows, "rows"), "shard", ["doc_id", "text_crc32", "size"], "slot")
