"""Ranks and exact quantiles within groups that no task gathers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch


def ranks(df: DataFrame, groups: Sequence[str], order: Sequence[Column], rank: str, count: str | None = None) -> DataFrame:
    """df with ``rank``, a row's place from 1 within its group, and ``count``,
    the group's size. Rows equal in ``order`` are interchangeable.

    A range partitioning on groups and order cuts even one huge group into many
    tasks. A row's place within its task comes from a running id after a sort;
    what precedes a task within the group is a running sum over one row per
    (task, group). Group values may be null.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    given = scratch.keep(df, "given")  # range bounds are sampled from it
    keys = [*[F.col(g) for g in groups], *order]
    placed = given.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.keep(placed.withColumn("_task", F.shiftright("_at", 33)), "placed")
    scratch.drop(given)
    # one row per (task, group): as small as tasks and groups together
    counts = placed.groupBy("_task", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole)}).drop("_n")
    c = counts.select(*[F.col(x).alias(f"_c{i}") for i, x in enumerate(["_task", *groups])], "_first", "_before", "_all")
    on = [F.col(x).eqNullSafe(F.col(f"_c{i}")) for i, x in enumerate(["_task", *groups])]
    out = placed.join(c, on).withColumn(rank, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    if count:
        out = out.withColumn(count, F.col("_all"))
    return out.select(*df.columns, rank, *([count] if count else []))


def _last_places(scratch: Scratch, values: DataFrame, group: str, value: str, count: str) -> DataFrame:
    """Distinct values and how often each occurs, with _last, the place of a
    value's last occurrence within its group, from 1, and _all, the group's
    size. As in ``ranks``, no task gathers a group."""
    given = scratch.keep(values.select(group, value, count), "given")  # range bounds are sampled from it
    placed = given.repartitionByRange(group, value).sortWithinPartitions(group, value).withColumn("_task", F.spark_partition_id())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            n = batch.column(count).to_numpy(zero_copy_only=False)
            if not len(n):
                continue
            g = batch.column(group).to_numpy(zero_copy_only=False)
            upto = np.cumsum(n)
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            before = (upto - n)[starts] - np.where((np.arange(len(starts)) == 0) & (g[0] == last), total, 0)
            upto = upto - np.repeat(before, np.diff(np.append(starts, len(n))))
            last, total = g[-1], int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto)], [*batch.schema.names, "_upto"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", _upto long"
    placed = scratch.keep(placed.mapInArrow(running, schema), "placed")
    scratch.drop(given)
    # one row per (task, group): as small as tasks and groups together
    counts = placed.groupBy("_task", group).agg(F.max("_upto").alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_task", group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    return placed.join(F.broadcast(counts), ["_task", group]).withColumn("_last", F.col("_before") + F.col("_upto"))


def counted_ranks(values: DataFrame, group: str, value: str, count: str, rank: str) -> DataFrame:
    """(group, value, rank) from distinct values and how often each occurs: the
    mean place of a value's occurrences within its group, from 1."""
    scratch = Scratch(values.sparkSession, "ranks")
    found = _last_places(scratch, values, group, value, count)
    # a table of its own, whose size a join with it knows
    return scratch.keep(found.select(group, value, (F.col("_last") - (F.col(count) - 1) / 2).alias(rank)), "counted")


def counted_percentiles(values: DataFrame, group: str, value: str, count: str, wanted: dict[str, float]) -> DataFrame:
    """``percentiles`` from distinct values and how often each occurs."""
    found = _last_places(Scratch(values.sparkSession, "ranks"), values, group, value, count)
    last = F.col("_last") - 1  # places from zero
    sums = []
    for name, q in wanted.items():
        at = (F.col("_all") - 1) * F.lit(q)
        low, high = (F.min(F.when(last >= place, F.col(value))) for place in (F.floor(at), F.ceil(at)))
        sums.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return found.groupBy(group).agg(*sums)


def percentiles(df: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(groups, <name>…): exact quantiles by linear interpolation between order
    statistics; null values are skipped, groups without any have no row."""
    placed = ranks(df.where(F.col(value).isNotNull()).select(*groups, value), groups, [F.col(value)], "_r", "_n")
    at = {name: (F.col("_n") - 1) * F.lit(q) for name, q in wanted.items()}
    near = None
    for a in at.values():
        hit = (F.col("_r") - 1).between(F.floor(a), F.ceil(a))
        near = hit if near is None else near | hit

    def value_at(a: Column, place: Column) -> Column:
        return F.max(F.when(F.col("_r") - 1 == place, F.col(value)))

    picked = placed.where(near)
    sums = []
    for name, a in at.items():
        low, high = value_at(a, F.floor(a)), value_at(a, F.ceil(a))
        part = F.max(a - F.floor(a))
        sums.append((low + (high - low) * part).alias(name))
    return picked.groupBy(*groups).agg(*sums)
