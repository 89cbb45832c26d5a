"""Near-duplicates by the Jaccard similarity of word shingles.

Candidates share one of ``BANDS`` bands of ``ROWS`` MinHash values; a pair of
similarity 0.8 misses all of them with probability (1 - 0.8^4)^20 < 0.00003.
Every link is verified on the whole sets. Bands with the same members are one
file, and only texts in a file are read again. A file returns a spanning forest
of its links. A file of more than ``FILE`` members is dealt into parts that all
hold its first member. A part's members that hang together with the first one
are connected; those that do not (``alone``) visit all other parts and are
compared with every member there, so no link that connects anything is lost, and
a task holds one part and one visitor at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .components import components
from .filters import candidates
from .simhash import SEED, fingerprint_column, shingle_hashes
from .simhash import links as simhash_links

BANDS = 20
ROWS = 4
FILE = 512
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """Signed band values of a set of shingle hashes."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12), None] * _ODD).min(axis=0))
    cells = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(c.tobytes(), SEED) for c in cells], np.uint64).view(np.int64).tolist()


def _longs(text: Column, made) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([made(t.as_py()) for t in texts], pa.list_(pa.int64()))

    return column(F.coalesce(text, F.lit("")).cast("binary"))


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have the similarity."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def _forest(ids: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """(first, member) of every tree of the links among members of a file, so
    that a group which shares many bands gives the same edges in each of them."""
    left, edges = list(range(len(ids))), []
    while left:
        root, front, left = ids[left[0]], [left[0]], left[1:]
        while front and left:
            at, rest = front.pop(), []
            for y in left:
                if _near(sets[at], sets[y], threshold):
                    edges.append((root, ids[y]))
                    front.append(y)
                else:
                    rest.append(y)
            left = rest
    return edges


def _with_first(first: int, edges: list[tuple[int, int]]) -> set[int]:
    """Members of the first one's tree."""
    return {first} | {b for a, b in edges if a == first}


def _named(names: dict[int, int], vertex: int) -> int:
    """The name of a vertex's tree."""
    while names.setdefault(vertex, vertex) != vertex:
        names[vertex] = vertex = names[names[vertex]]
    return vertex


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(leading columns…, set) of rows whose last column is a list of shingles."""
    for batch in batches:
        sets = batch.column(batch.num_columns - 1)
        flat, ends = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False))
        others = [c.to_pylist() for c in batch.columns[:-1]]
        for i, end in enumerate(ends.tolist()):
            # a copy, so that a held set does not hold its whole batch
            yield (*[c[i] for c in others], flat[ends[i - 1] if i else 0 : end].copy())


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int8()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]], ["kind", "a", "b"])


FOUND = "kind byte, a long, b long"


def _linker(threshold: float):
    """mapInArrow function over rows (file, part, parts, vertex, shingles) sorted
    by file, part and whether they are the first: edges (kind 0), and members of
    files in several parts that do not hang on the first one (kind 1: file, vertex)."""

    def linked(key: tuple, ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
        edges = _forest(ids, sets, threshold)
        out = [(0, a, b) for a, b in edges]
        if key and key[2] > 1:
            tree = _with_first(ids[0], edges)
            out += [(1, key[0], v) for v in ids if v not in tree]
        return out

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, out = (), [], [], []
        for file, part, parts, vertex, shingles in _rows(batches):
            if key != (file, part, parts):
                out += linked(key, ids, sets)
                key, ids, sets = (file, part, parts), [], []
                if len(out) > 10_000:
                    yield _found(out)
                    out = []
            ids.append(vertex)
            sets.append(shingles)
        yield _found(out + linked(key, ids, sets))

    return runs


def _visits(threshold: float):
    """mapInArrow function over rows (file, part, visits, alone, vertex,
    shingles) sorted by file, part and visits: links of visitors with a part's
    members. Those that hang on the file's first member are one tree, so a link
    with any of them is one with the first, in whatever part; a link within a
    tree is none. Visitors' texts are not held, so a part is all that memory
    holds of them."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, names, out = None, [], {}, []
        for file, part, visits, alone, vertex, shingles in _rows(batches):
            if key != (file, part):
                key, members, names = (file, part), [], {}
            if not visits:
                members.append((alone, vertex, shingles))
                continue
            first = min(v for _, v, _ in members)  # every part holds it
            for lone, other, its in members:
                other_tree = other if lone else first
                if other != vertex and _named(names, vertex) != _named(names, other_tree) and _near(shingles, its, threshold):
                    names[_named(names, vertex)] = _named(names, other_tree)
                    out.append((0, vertex, other_tree))
            if len(out) > 10_000:
                yield _found(out)
                out = []
        yield _found(out)

    return runs


def links(scratch: Scratch, texts: DataFrame, signed: DataFrame, shingle: int, threshold: float, most: int = FILE) -> DataFrame:
    """(a, b): verified links among the vertices of signed (vertex, values),
    enough of them to connect whatever all links of candidates connect."""
    filed = signed.select("vertex", F.posexplode("values").alias("band", "value"))
    found = filed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("vertex").alias("first"), F.bit_xor(F.xxhash64("vertex")).alias("members")).where("n > 1")
    files = found.groupBy("n", "first", "members").agg(F.min(F.struct("band", "value")).alias("f")).select("f.band", "f.value", "n", "first")
    files = scratch.keep(files, "files")
    parts = F.ceil(F.col("n") / most).cast("int")
    own = F.array(F.pmod(F.xxhash64("vertex"), parts).cast("int"))
    part = F.when(F.col("vertex") == F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(own)
    members = filed.join(files, ["band", "value"]).select(F.xxhash64("band", "value").alias("file"), F.explode(part).alias("part"), parts.alias("parts"), (F.col("vertex") != F.col("first")).alias("later"), "vertex")
    members = scratch.keep(members, "members")
    # texts outside all files stop at a bitmap, so that they are not exchanged
    wanted = scratch.keep(members.select("vertex").distinct(), "wanted")
    may = candidates(scratch, texts.withColumnRenamed("vertex", "digest"), wanted.withColumnRenamed("vertex", "digest")).withColumnRenamed("digest", "vertex")
    read = may.join(wanted, "vertex", "left_semi").dropDuplicates(["vertex"])
    sets = read.select("vertex", _longs(F.col("text"), lambda t: np.unique(shingle_hashes(t, shingle)).view(np.int64).tolist()).alias("shingles"))
    sets = scratch.keep(sets, "sets")

    def dealt(rows: DataFrame, columns: list[str], *then: str) -> DataFrame:
        held = rows.join(sets, "vertex")
        return held.repartition("file", "part").sortWithinPartitions("file", "part", *then, "vertex").select(*columns, "shingles")

    out = dealt(members, ["file", "part", "parts", "vertex"], "later").mapInArrow(_linker(threshold), FOUND)
    out = scratch.keep(out, "links")
    edges = out.where("kind = 0").select("a", "b")
    alone = out.where("kind = 1").select(F.col("a").alias("file"), F.col("b").alias("vertex")).distinct()
    if alone.isEmpty():
        return edges
    # what does not hang on the first member visits the file's other parts
    mine = members.join(alone.select("file").distinct(), "file", "left_semi").join(alone.withColumn("alone", F.lit(True)), ["file", "vertex"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    visitors = mine.where("alone").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("to != part").withColumn("part", F.col("to")).drop("to")
    both = mine.withColumn("visits", F.lit(False)).unionByName(visitors.withColumn("visits", F.lit(True)))
    more = dealt(both, ["file", "part", "visits", "alone", "vertex"], "visits").mapInArrow(_visits(threshold), FOUND)
    return edges.unionByName(scratch.keep(more, "visits").select("a", "b"))


def by_fingerprint(scratch: Scratch, signed: DataFrame) -> DataFrame:
    """(a, b): links that connect the vertices of signed (vertex, print) whose
    fingerprints are linked (``simhash.links``), through the fingerprints."""
    prints = scratch.keep(signed.groupBy("print").agg(F.count(F.lit(1)).alias("n")), "prints")
    linked = scratch.keep(simhash_links(scratch, prints.select("print")).distinct(), "linked")
    several = linked.select(F.col("a").alias("print")).unionByName(linked.select(F.col("b").alias("print"))).unionByName(prints.where("n > 1").select("print"))
    several = scratch.keep(several.distinct(), "several")
    return linked.select("a", "b").unionByName(signed.join(several, "print").select(F.col("vertex").alias("a"), F.col("print").alias("b")))


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, most: int = FILE, fingerprints: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, text_key (XXH64 of the text) and
    component_key (a key that names the component). With ``fingerprints`` texts
    link by SimHash too, whatever their similarity."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    text = F.col(text_col)
    own = [fingerprint_column(text, shingle).alias("print")] if fingerprints else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), _longs(text, lambda t: bands(shingle_hashes(t, shingle))).alias("values"), *own)
    rows = scratch.keep(rows, "signed")
    signed = rows.groupBy(F.col("text_key").alias("vertex")).agg(F.first("values").alias("values"), *[F.first("print").alias("print") for _ in own])
    texts = docs.select(F.xxhash64(text_col).alias("vertex"), text.alias("text"))
    edges = links(scratch, texts, signed.select("vertex", "values"), shingle, threshold, most)
    if fingerprints:
        edges = edges.unionByName(by_fingerprint(scratch, signed.select("vertex", "print")))
    roots = components(scratch, edges)
    return rows.join(roots, rows["text_key"] == roots["vertex"], "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("component_key"))
