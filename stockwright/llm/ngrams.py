"""Hashed byte n-grams: buckets, corpus counts and log-likelihood ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .filters import candidates, make_filter

#: Length of an n-gram in bytes; four letters, or a letter or two of other scripts.
N = 4
BITS = 14
BUCKETS = 1 << BITS
#: Log ratios are whole multiples of 2^-20, so that sums are exact in any order.
SCALE = 1 << 20
#: Counts that each bucket has beforehand on either side.
PSEUDO = 10
#: Bytes that are hashed at once.
PIECE = 1 << 22


def buckets(text: bytes) -> np.ndarray:
    """Bucket of each n-gram of a text, in order."""
    a = np.frombuffer(text, np.uint8)
    if len(a) < N:
        return np.zeros(0, np.uint32)
    a = a.astype(np.uint32)
    code = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _pieces(text: bytes) -> Iterator[bytes]:
    for at in range(0, max(1, len(text) - N + 1), PIECE):
        yield text[at : at + PIECE + N - 1]


def counts(text: bytes) -> np.ndarray:
    return sum((np.bincount(buckets(p), minlength=BUCKETS) for p in _pieces(text)), np.zeros(BUCKETS, np.int64))


def score(text: bytes, weights: np.ndarray) -> tuple[int, int]:
    """(sum of weights, number of n-grams) of a text."""
    total = n = 0
    for p in _pieces(text):
        b = buckets(p)
        total += int(weights[b].sum())
        n += len(b)
    return total, n


def count(docs: DataFrame, parts: int = 1) -> np.ndarray:
    """Counts over all rows of (text binary, part int): parts by buckets. A task
    sends one row per part and bucket; so many come to the driver, whatever the
    input."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, BUCKETS), np.int64)
        for batch in batches:
            for text, part in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for p in _pieces(text.as_py() or b""):
                    total[part] += np.bincount(buckets(p), minlength=BUCKETS)
        part, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[part, bucket])], ["part", "bucket", "n"])

    found = docs.select("text", "part").mapInArrow(some, "part int, bucket int, n long").groupBy("part", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((parts, BUCKETS), np.int64)
    for r in found.collect():
        out[r["part"], r["bucket"]] = r["n"]
    return out


def trusted_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs (_id, ...) whose _id is among those of ``trusted``. Rows
    that pass a bitmap of these ids by mistake are found by their ids alone and
    get a bitmap of their own; only rows that pass both are exchanged."""
    scratch = Scratch(docs.sparkSession, "trusted")
    ids = scratch.keep(trusted.where(F.col("_id").isNotNull()).select("_id").distinct(), "ids")
    keyed = docs.where(F.col("_id").isNotNull()).withColumn("digest", F.xxhash64(F.col("_id")))
    may = candidates(scratch, keyed, ids.select(F.xxhash64("_id").alias("digest")))
    wrong = scratch.keep(may.select("_id", "digest").join(ids, "_id", "left_anti").select("digest").distinct(), "wrong")
    doubt = make_filter(scratch, wrong, wrong.count())
    if not doubt.bounded:
        return may.drop("digest").join(ids, "_id", "left_semi")
    marked = doubt.mark(may, "_doubt")
    sure = marked.where("NOT _doubt").drop("digest", "_doubt")
    return sure.unionByName(marked.where("_doubt").drop("digest", "_doubt").join(ids, "_id", "left_semi"))


def count_sides(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all rows of (_id, text binary) whose _id is among those of
    ``trusted``, and over all rows."""
    raw = count(docs.select("text", F.lit(0).alias("part")))
    target = count(trusted_rows(docs.select("_id", "text"), trusted).select("text", F.lit(0).alias("part")))
    return target[0], raw[0]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the ratio of the two multinomials, as whole multiples of
    1 / SCALE. Raw counts are brought to the trusted total, and both get ``PSEUDO``
    pseudo-counts a bucket, so a bucket that little text speaks for is near
    zero. Without trusted text all ratios are zero."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS, np.int64)
    expected = raw * (target.sum() / raw.sum())
    return np.round(np.log((target + PSEUDO) / (expected + PSEUDO)) * SCALE).astype(np.int64)
