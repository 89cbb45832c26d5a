"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verification.

A fingerprint has 64 bits; bit i is set where more than half of the text's
shingle hashes (XXH64, seed 42) have it. Two fingerprints link when they differ
in at most ``MAX_DISTANCE`` = 4 bits.

Pigeonhole: the 64 bits are cut into 7 blocks. Fingerprints that differ in 4
bits or fewer agree on at least 3 whole blocks, so each distinct fingerprint is
filed under each of the 35 choices of 3 blocks (27 or 28 bits, which random
fingerprints hardly share), and only members of one file are compared, by
exact Hamming distance. A file returns a spanning forest of its links, never all
pairs: at most one edge a member. A file with more than ``FILE`` members is not
gathered: its members are filed again by the same rule on the bits they do not
share yet, each under 35 masks; a fingerprint is filed at most 35^3 times, which
only overfull files on every level cause. After three levels at most 13 bits are
open, so a file has at most 8,192 distinct fingerprints whatever the input, and
no link is lost.

Equal texts have equal fingerprints and are one vertex, so copies cost nothing
beyond their own row.

Defined results: null text is an empty text; texts without a word have
fingerprint zero and link like any other; null doc_ids keep their row and are
never the smallest of a component unless all of it is null; repeated rows give
repeated result rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, row_key
from .components import components, hand_out
from .filters import candidates, make_filter

MAX_DISTANCE = 4
BLOCKS = 7
SHINGLE = 4
SEED = 42
#: Members of a file that one task holds and compares at once.
FILE = 4096
LEVELS = 3


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one UTF-8 text, in order."""
    import xxhash

    found = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space count
    if not found:
        return np.zeros(0, "<u8")
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    line, digest = memoryview(b" ".join(found)), xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """A text column's fingerprints as signed longs (the same 64 bits)."""

    @F.arrow_udf(T.LongType())
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t, shingle) for t in texts.to_pylist()), dtype=np.uint64, count=len(texts)).view(np.int64))

    return prints(F.coalesce(text, F.lit("")).cast("binary"))


# ----------------------------------------------------------------- pigeonholes


def _choices(open_bits: list[int]) -> list[int]:
    """Masks of every choice of BLOCKS - MAX_DISTANCE blocks of these bits."""
    size, more = divmod(len(open_bits), BLOCKS)
    cuts = np.cumsum([0] + [size + (i < more) for i in range(BLOCKS)])
    blocks = [sum(1 << b for b in open_bits[cuts[i] : cuts[i + 1]]) for i in range(BLOCKS)]
    return [sum(c) for c in combinations(blocks, BLOCKS - MAX_DISTANCE)]


def masks(kept: int = 0) -> list[int]:
    """The files under a mask of bits that members share already."""
    return [kept | m for m in _choices([b for b in range(64) if not kept >> b & 1])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(x: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among these distinct fingerprints."""
    left, edges = x.copy(), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= limit
            if near.any():
                found = left[near]
                edges += [(int(at), int(y)) for y in found]
                front += list(found)
                left = left[~near]
    return edges


def _linker(limit: int, most: int, last: bool):
    """mapInArrow function over rows (mask, print) that are sorted by file."""

    def rows(kinds: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.RecordBatch.from_arrays([pa.array(join(kinds, np.int8)), pa.array(join(a, np.int64)), pa.array(join(b, np.int64))], ["kind", "a", "b"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_mask, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        over: tuple[int, int] | None = None  # the file that is being passed on

        def link(mask: np.ndarray, prints: np.ndarray, final: bool) -> pa.RecordBatch:
            nonlocal held_mask, held, over
            key = prints & mask
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(mask)]))
            kinds, left, right = [], [], []

            def pass_on(s: int, e: int) -> None:
                for deeper in masks(int(mask[s])):
                    kinds.append(np.ones(e - s, np.int8))
                    left.append(np.full(e - s, _signed(deeper), np.int64))
                    right.append(prints[s:e].view(np.int64))

            begin = 0  # rows before it are done with
            if over == (int(mask[0]), int(key[0])):
                pass_on(0, int(ends[0]))
                begin = int(ends[0])
            if begin < len(mask):
                over = None
            stop = len(mask) if final else max(begin, int(starts[-1]))  # the last file may go on
            for i in np.flatnonzero((ends - starts > 1) & (starts >= begin) & (ends <= stop)).tolist():
                s, e = int(starts[i]), int(ends[i])
                if e - s > most and not last:
                    pass_on(s, e)
                elif edges := _forest(prints[s:e], limit):
                    pairs = np.array(edges, dtype=np.uint64).view(np.int64)
                    kinds.append(np.zeros(len(pairs), np.int8))
                    left.append(pairs[:, 0])
                    right.append(pairs[:, 1])
            if len(mask) - stop > most and not last:
                over = (int(mask[stop]), int(key[stop]))
                pass_on(stop, len(mask))
                stop = len(mask)
            held_mask, held = mask[stop:], prints[stop:]
            return rows(kinds, left, right)

        for batch in batches:
            mask = np.concatenate((held_mask, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            prints = np.concatenate((held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(mask):
                yield link(mask, prints, False)
        if len(held):
            yield link(held_mask, held, True)

    return runs


def links(scratch: Scratch, prints: DataFrame, limit: int = MAX_DISTANCE, most: int = FILE) -> DataFrame:
    """Distinct fingerprints (print) -> (a, b): links whose components are
    those of all links. Unlinked fingerprints have no row."""
    filed = prints.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks()])).alias("mask"), "print")
    found: DataFrame | None = None
    for level in range(LEVELS):
        last = level == LEVELS - 1
        key = F.col("print").bitwiseAND(F.col("mask"))
        out = filed.repartition(F.col("mask"), key).sortWithinPartitions(F.col("mask"), key)
        out = scratch.keep(out.mapInArrow(_linker(limit, most, last), "kind byte, a long, b long"), f"files{level}")
        here = out.where("kind = 0").select("a", "b")
        found = here if found is None else found.unionByName(here)
        filed = out.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("print"))
        if last or filed.isEmpty():
            break
    return found


# -------------------------------------------------------------------- operator


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_DISTANCE, most: int = FILE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable), component_key (a fingerprint that
    names the component) and text_key (XXH64 of the text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), fingerprint_column(F.col(text_col)).alias("print")), "prints")
    distinct = scratch.keep(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(scratch, links(scratch, distinct.select("print"), limit, most))
    ids = distinct.join(roots, distinct["print"] == roots["vertex"], "left").select("print", "first_id", F.coalesce("root", "print").alias("component_key"))
    ids = scratch.keep(ids, "members")
    least = ids.groupBy("component_key").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    ids = scratch.keep(hand_out(ids, "component_key", least, ids.count()).select("print", "component_key", "component_id"), "ids")
    return prints.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "component_key", "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float | None = None) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with
    the smallest doc_id stays, with all columns of docs (null doc_ids stay only
    where a component has no other; of rows that share that doc_id one text
    stays). Rows that repeat the same doc_id and text count once. With a
    ``threshold`` texts link by fingerprints of their shingles and, as these miss
    pairs of that Jaccard similarity, by it too (``jaccard.alike``), else by
    fingerprints of four-word shingles alone. Rows whose
    text is in no component of several rows pass where they are; only the others
    are exchanged."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    if threshold is None:
        near = near_duplicates(docs, id_col, text_col)
    else:
        from .jaccard import alike

        near = alike(docs, id_col, text_col, shingle, threshold, fingerprints=True).withColumn("fingerprint", F.lit(""))
    near = scratch.keep(near.select("doc_id", "fingerprint", "text_key", "component_key"), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint", "text_key")).alias("s")
    least = scratch.keep(near.groupBy("component_key").agg(first, F.count(F.lit(1)).alias("n")), "least")
    several = least.where("n > 1").select(F.col("component_key").alias("digest"))
    crowded = candidates(scratch, near.select("text_key", F.col("component_key").alias("digest")), several)
    crowded = scratch.keep(crowded.select(F.col("text_key").alias("digest")).distinct(), "crowded")
    found = make_filter(scratch, crowded, crowded.count())

    def marked(rows: DataFrame) -> DataFrame:
        return found.mark(rows, "_may") if found.bounded else rows.withColumn("_may", F.lit(True))

    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # a clashing column is not in the way
    rows = marked(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()], F.xxhash64(text_col).alias("digest")))
    # the first rows of single components that pass the filter are among them
    stays = marked(least.select(F.col("s.text_key").alias("digest"), F.col("s.doc_id").alias("doc_id"))).where("_may")
    stays = stays.select(row_key(F.col("digest"), F.col("doc_id")).alias("_key"))
    mine = rows.where("_may").withColumn("_key", row_key(F.col("digest"), F.col(own[id_col]))).join(stays, "_key", "left_semi").dropDuplicates(["_key"])
    return rows.where("NOT _may").select(*own.values()).unionByName(mine.select(*own.values())).toDF(*docs.columns)
