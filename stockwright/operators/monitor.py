"""Forecast monitoring: realised errors, rolling MASE, spikes, input drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def realised_error(log: DataFrame) -> DataFrame:
    return log.withColumn("error", F.col("y") - F.col("forecast")).withColumn("abs_error", F.abs("error"))


def rolling_mase(errors: DataFrame, scales: DataFrame, window: int) -> DataFrame:
    """Trailing mean absolute error over each series' own scale (series_id, scale)."""
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(-(window - 1), 0)
    r = errors.withColumn("_mae", F.avg("abs_error").over(w)).join(scales, "series_id", "left")
    return r.withColumn("rolling_mase", F.col("_mae") / F.nullif("scale", F.lit(0.0))).drop("_mae", "scale")


def error_spikes(rolling: DataFrame, threshold: float) -> DataFrame:
    return rolling.where(F.col("rolling_mase") > threshold).select("series_id").distinct()


def input_drift(baseline: DataFrame, recent: DataFrame, z: float = 3.0) -> DataFrame:
    """(series_id, shift, std): recent mean more than z baseline deviations off;
    with a constant baseline any shift counts."""
    b = baseline.groupBy("series_id").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))
    r = recent.groupBy("series_id").agg(F.avg("y").alias("recent"))
    d = b.join(r, "series_id").withColumn("shift", F.abs(F.col("recent") - F.col("mean")))
    return d.where(((F.col("std") == 0) & (F.col("shift") > 0)) | ((F.col("std") > 0) & (F.col("shift") > z * F.col("std")))).select("series_id", "shift", "std")
