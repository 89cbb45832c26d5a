"""Rolling-origin folds, samples, and per-series statistics of training windows."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..grain import Grain


def last_day(panel: DataFrame) -> date:
    return panel.agg(F.max("date")).first()[0]


def fold_rows(end: date, grain: Grain) -> list[tuple[int, date, date, date]]:
    """(fold, train_end, test_start, test_end): blocks of a horizon that end at
    ``end``, none overlapping, training on everything before."""
    rows = []
    for fold in range(1, grain.n_folds + 1):
        test_end = grain.before(end, grain.horizon * (grain.n_folds - fold))
        start = grain.before(test_end, grain.horizon - 1)
        rows.append((fold, grain.before(start, 1), start, test_end))
    return rows


def folds(spark: SparkSession, end: date, grain: Grain) -> DataFrame:
    """``fold_rows`` as a table."""
    return spark.createDataFrame(fold_rows(end, grain), "fold int, train_end date, test_start date, test_end date")


def training(panel: DataFrame, folds_: DataFrame) -> DataFrame:
    """Rows of every fold's training window (a range join with a few rows)."""
    return panel.join(F.broadcast(folds_), panel.date <= folds_.train_end)


def testing(panel: DataFrame, folds_: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(folds_), panel.date.between(folds_.test_start, folds_.test_end))


def sample_seeded(panel: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """Rows of n series drawn by a seeded generator over sorted ids; all of them
    if n is none or covers them. The ids come to the driver: use it for the
    bounded sets of series that evaluation draws from, ``sample_hashed`` else."""
    if n is None:
        return panel
    ids = [r[0] for r in panel.select("series_id").distinct().orderBy("series_id").collect()]
    if n >= len(ids):
        return panel
    chosen = np.random.default_rng(seed).choice(np.array(ids, dtype=object), size=n, replace=False)
    keep = panel.sparkSession.createDataFrame([(str(x),) for x in chosen], "series_id string")
    return panel.join(F.broadcast(keep), "series_id", "left_semi")


def sample_hashed(panel: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Rows of the n series of smallest seeded digest, wholly on executors."""
    ids = panel.select("series_id").distinct().orderBy(digest(F.col("series_id"), seed), "series_id").limit(n)
    return panel.join(ids, "series_id", "left_semi")


def digest(series: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), series))


def insample_scales(train: DataFrame, lag: int) -> DataFrame:
    """(fold, series_id, scale_mae, scale_mse) of the naive error at a lag; a
    zero scale is missing."""
    w = Window.partitionBy("fold", "series_id").orderBy("date")
    d = train.withColumn("d", F.col("y") - F.lag("y", lag).over(w))
    out = d.groupBy("fold", "series_id").agg(F.avg(F.abs("d")).alias("scale_mae"), F.avg(F.col("d") * F.col("d")).alias("scale_mse"))
    return out.select("fold", "series_id", F.nullif("scale_mae", F.lit(0.0)).alias("scale_mae"), F.nullif("scale_mse", F.lit(0.0)).alias("scale_mse"))


def revenue_weights(train: DataFrame, grain: Grain) -> DataFrame:
    """(fold, series_id, weight): revenue of the last horizon of training."""
    recent = train.where(F.col("date") > grain.shift(F.col("train_end"), -grain.horizon))
    return recent.groupBy("fold", "series_id").agg(F.sum(F.col("y") * F.coalesce("price", F.lit(0.0))).alias("weight"))


def train_stats(train: DataFrame) -> DataFrame:
    """(fold, series_id, zero_rate, volume)."""
    return train.groupBy("fold", "series_id").agg(F.avg((F.col("y") == 0).cast("double")).alias("zero_rate"), F.avg("y").alias("volume"))


def unit_prices(train: DataFrame) -> DataFrame:
    """(fold, series_id, unit_price): mean training price, else the mean over
    all training rows of the fold."""
    every = train.groupBy("fold").agg(F.avg("price").alias("every"))
    per = train.groupBy("fold", "series_id").agg(F.avg("price").alias("p"))
    return per.join(F.broadcast(every), "fold").select("fold", "series_id", F.coalesce("p", "every").alias("unit_price"))
