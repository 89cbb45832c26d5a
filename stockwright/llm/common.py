"""Helpers that several operators share: word splitting, distributed ranks and
fields read by name only."""


from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch

__all__ = ["Scratch", "ascii_lower", "free_name", "n_words", "ranks", "row_key", "table", "words"]

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = "[\\x20\\x09-\\x0D]+"
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, LOWER_FROM, LOWER_TO)


def free_name(wanted: str, columns: Sequence[str]) -> str:
    """A column name that no column of the table has, whatever its case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def row_key(*parts: Column) -> Column:
    """One binary key of several columns, equal only where all are (nulls too).

    A join and a dropDuplicates on it share one exchange of the rows."""
    out = []
    for part in parts:
        text = part.cast("string").cast("binary")
        # each part is written with its length, so that none runs into the next
        size = F.coalesce(F.octet_length(text).cast("string"), F.lit("null"))
        out += [size.cast("binary"), F.lit(b":"), F.coalesce(text, F.lit(b""))]
    return F.concat(*out)


def ranks(scratch: Scratch, df: DataFrame, group: str, order: Sequence[str], rank: str) -> DataFrame:
    """Rank rows from 0 within each group without gathering a group.

    A range partitioning on (group, order) cuts even one huge group into many
    tasks; a row's place within its task comes from monotonically_increasing_id
    after a sort, and what precedes a task within the group is a running sum
    over one count per (task, group). Rows equal in all keys are interchangeable.
    ``group`` must not be null. ``df`` should be cheap to read, as range bounds
    are sampled from it.
    """
    keys = [F.col(group), *[F.col(c) for c in order]]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.keep(placed.withColumn("_task", F.shiftright("_at", 33)), "placed")
    counts = placed.groupBy("_task", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = placed.join(counts, ["_task", group])
    return out.withColumn(rank, F.col("_at") - F.col("_first") + F.col("_before")).drop("_task", "_at", "_first", "_before")
