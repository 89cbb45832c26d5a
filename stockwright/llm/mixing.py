"""Mixing sources to target weights by systematic sampling.

Sources in order of code points (null last) weigh 5, 2, 1, repeating, and share
all words by weight. No source is asked for more than ``REPEAT`` = 3 times its
own words; what exceeds that is shared anew by weight among the others until
none is above. That is one water level: with the sources in order of size to
weight, those below the level are full, and the level of the rest follows from
running sums, so one pass over the small source table finds it.

Within a source every document is expected in ratio = target / source size
copies. Documents are placed in order of size, so that neighbours are alike; the
prefix sum of expected copies, shifted by one random offset a source, is cut at
integers, and a document is emitted once per integer it crosses. The words
taken then differ from the target by about the size of one document. The prefix
sum needs a document's rank in its source, which is found without gathering a
source (see ``common.ranks``). The offset is a hash of the source and the seed,
a multiple of 2^-16, so reruns agree.

Rows with equal doc_id, source and size are interchangeable in the order. Null
texts and texts without a word have size 0 and are placed first; null doc_ids
precede others. All of it is DataFrame functions. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_name, n_words, ranks, row_key

WEIGHTS = (5, 2, 1)
REPEAT = 3
SEED = 0


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) -> with source_no and target (double).

    One row per source: the table is as small as the list of sources, whose
    order is found in one task. That is meant for up to some millions of
    sources of about 100 bytes; documents are never in it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("source_no", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("most", F.lit(repeat) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0))).withColumn("share", F.col("weights") - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    s = s.withColumn("full", F.col("left") * F.col("weight") > F.col("most") * F.col("share")).withColumn("place", F.row_number().over(order))
    level = F.min(F.when(~F.col("full"), F.struct("place", "left", "share"))).over(whole)
    s = s.withColumn("level", level)
    at = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.share")
    return s.select("source", "source_size", "source_no", F.when(F.col("full"), F.col("most").cast("double")).otherwise(at).alias("target"))


def offset(source: Column, seed: int = SEED) -> Column:
    """One random offset in [0, 1) for a source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("long") / F.lit(65536.0)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, text_key, size, source_size,
    target, copies (how often the mix takes the document)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_key"), n_words(F.col(text_col)).alias("size"))
    sizes = scratch.keep(sizes, "sizes")
    sources = scratch.keep(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    placed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(sizes["doc_id"], sizes["source"], "text_key", "size", "source_size", "source_no", "target")
    placed = ranks(scratch, scratch.keep(placed, "sized"), "source_no", ["size", "doc_id", "text_key"], "rank")
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    until = lambda n: F.floor(offset(F.col("source"), seed) + ratio * n)
    copies = F.least(until(F.col("rank") + 1) - until(F.col("rank")), F.lit(REPEAT).cast("long"))
    return placed.withColumn("copies", F.coalesce(copies, F.lit(0).cast("long"))).drop("rank", "source_no")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with all
    columns. Rows equal in doc_id, source and text are one document that is
    taken as often as they are together."""
    key, times = free_name("row_key_", docs.columns), free_name("copies_", docs.columns)
    taken = plan(docs, id_col, text_col, source_col, seed).where("copies > 0")
    taken = taken.groupBy(row_key(F.col("text_key"), F.col("doc_id"), F.col("source")).alias(key)).agg(F.sum("copies").alias(times))
    keyed = docs.withColumn(key, row_key(F.xxhash64(text_col), F.col(id_col), F.col(source_col)))
    once = keyed.join(taken, key).dropDuplicates([key])
    again = free_name("copy_", [*docs.columns, key, times])
    return once.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    return plan(docs, seed=seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
