"""Sinks: resumable grids, JSON results, Parquet, CSV and Markdown tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def modified(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def cached(spark: SparkSession, source: str, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored table if it is newer than its source, else made and stored."""
    if not exists(spark, path) or modified(spark, path) < modified(spark, source):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(grid: DataFrame, path: str, keys: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run only grid points that are not stored yet, and append their rows."""
    spark = grid.sparkSession
    todo = grid
    if exists(spark, path):
        todo = grid.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    if not todo.isEmpty():
        run(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def json_column(df: DataFrame) -> Column:
    """A row as JSON with sorted keys; NaN and infinity become null."""
    cols = []
    for name, kind in sorted(df.dtypes):
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        cols.append(c.alias(name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    df.select(json_column(df).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, digits: int = 3, most: int = 200) -> str:
    """A small report table as Markdown (at most ``most`` rows)."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.limit(most).collect()])
