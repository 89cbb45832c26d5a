"""What a service calls: calibration, forecasts, reorder decisions, status."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mathx import Z90, z
from ..grain import Grain
from . import decision
from .models import registry
from .models.registry import arrays, served

MODEL = "TrailingMean"


class UnknownSeries(LookupError):
    """A request names series that the panel does not have."""


class Mismatch(ValueError):
    """Model and calibration do not belong together."""


class Missing(FileNotFoundError):
    """An artifact is absent; there is no silent fallback."""


@dataclass(frozen=True)
class Calibration:
    """Hold-out residuals per series with the model and lead time they are for."""

    residuals: DataFrame  # series_id, residual, zero_rate, volume
    model: str
    lead: int
    level: float
    granularity: str = "intermittency"

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        r = self.residuals.withColumn("fold", F.lit(0)).withColumn("model", F.lit(self.model))
        return r, decision.assign_buckets(r.select("fold", "series_id", "zero_rate", "volume"), self.granularity)

    def safety_stock(self) -> DataFrame:
        """(series_id, safety_stock)."""
        r, b = self._tables()
        return decision.series_safety_stock(r, b, self.level).select("series_id", "safety_stock")

    def lead_time_std(self) -> DataFrame:
        return self.safety_stock().withColumn("std", F.col("safety_stock") / z(self.level)).drop("safety_stock")

    def bucket_table(self) -> DataFrame:
        r, b = self._tables()
        return decision.bucket_safety_stock(r, b, self.level).select("bucket", "n", "std", "safety_stock")

    def interval(self, forecast: DataFrame) -> DataFrame:
        """80 % interval per period: p50 less and plus z sigma / sqrt(L)."""
        half = F.lit(Z90 / sqrt(self.lead)) * F.col("std")
        out = forecast.join(self.lead_time_std(), "series_id", "left")
        return out.withColumn("p10", F.greatest(F.col("p50") - half, F.lit(0.0))).withColumn("p90", F.col("p50") + half).drop("std")

    def save(self, path: str) -> None:
        tag = self.residuals.withColumns({"model": F.lit(self.model), "lead": F.lit(self.lead), "level": F.lit(self.level), "granularity": F.lit(self.granularity)})
        tag.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Calibration:
        try:
            t = spark.read.parquet(path)
        except Exception as e:
            raise Missing(path) from e
        m = t.select("model", "lead", "level", "granularity").first()
        return Calibration(t.drop("model", "lead", "level", "granularity"), *m)


def fit_calibration(panel: DataFrame, lead: int, level: float, grain: Grain, model: str = "MovingAverage", arrays_: DataFrame | None = None) -> Calibration:
    """Forecast the last lead time from everything before it; its residuals."""
    p = _hold_out(arrays(panel) if arrays_ is None else arrays_, model, lead, grain)
    return Calibration(p, MODEL, lead, level)


def _hold_out(a: DataFrame, model: str, lead: int, grain: Grain) -> DataFrame:
    @F.arrow_udf("residual double, zero_rate double, volume double")
    def measure(ys: pa.Array) -> pa.Array:
        size = pa.compute.list_value_length(ys).to_numpy(zero_copy_only=False)
        flat, at, out = ys.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size, np.zeros((3, len(size)))
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            y = flat[at[rows][:, None] + np.arange(n)]
            train, test = y[:, :-lead], y[:, -lead:]
            out[:, rows] = test.sum(axis=1) - registry.LOCAL[model](train, lead, grain).sum(axis=1), (train == 0).mean(axis=1), train.mean(axis=1)
        return pa.StructArray.from_arrays([pa.array(c) for c in out], ["residual", "zero_rate", "volume"])

    return a.where(F.size("ys") > lead).select("series_id", measure("ys").alias("m")).select("series_id", "m.*")


def validate(panel: DataFrame, ids: list[str]) -> None:
    known = {r[0] for r in panel.where(F.col("series_id").isin(ids)).select("series_id").distinct().collect()}
    if unknown := sorted(set(ids) - known):
        raise UnknownSeries(", ".join(unknown))


def forecast(panel: DataFrame, ids: list[str] | None, horizon: int, grain: Grain) -> DataFrame:
    """(series_id, date, p10, p50, p90). History is cut to the series asked for."""
    if ids is not None:
        validate(panel, ids)
        panel = panel.where(F.col("series_id").isin(ids))
    return served(panel, horizon, grain)


def reorder(panel: DataFrame, calibration: Calibration, lead: int, grain: Grain, on_hand: DataFrame | None = None, lot: float = 2.0, ids: list[str] | None = None) -> DataFrame:
    """Decision per series; stock that is not given is zero."""
    if calibration.model != MODEL:
        raise Mismatch(f"calibration is for {calibration.model}, the served model is {MODEL}")
    if calibration.lead != lead:
        raise Mismatch(f"calibration is for a lead time of {calibration.lead}, not {lead}")
    f = forecast(panel, ids, lead, grain)
    stats = f.groupBy("series_id").agg(F.sum("p50").alias("mean"), F.lit(0.0).alias("std"))
    stock = on_hand if on_hand is not None else panel.sparkSession.createDataFrame([], "series_id string, on_hand double")
    stats = stats.join(stock, "series_id", "left").withColumn("on_hand", F.coalesce("on_hand", F.lit(0.0)))
    unit = "days" if grain.name == "day" else "weeks"
    return decision.decide(stats, calibration.level, lead, calibration.safety_stock(), lot, unit=unit)


def status(panel: DataFrame, calibration: Calibration) -> DataFrame:
    """One row of service metrics."""
    s = panel.agg(F.countDistinct("series_id").alias("n_series"), F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("last_date"))
    return s.withColumns({"model": F.lit(calibration.model), "lead": F.lit(calibration.lead), "level": F.lit(calibration.level)})


def run_batch(panel: DataFrame, calibration: Calibration, lead: int, grain: Grain, path: str, lot: float = 2.0) -> DataFrame:
    """Decisions of every series, written as CSV."""
    out = reorder(panel, calibration, lead, grain, lot=lot)
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def history(panel: DataFrame, rows: int = 90) -> DataFrame:
    """Each series' last rows, for display."""
    w = Window.partitionBy("series_id").orderBy(F.desc("date"))
    return panel.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows).drop("_n")


def traffic_light(p):
    """Low, medium or high risk of running out."""
    return F.when(p < 0.15, F.lit("low")).when(p < 0.5, F.lit("medium")).otherwise(F.lit("high"))
