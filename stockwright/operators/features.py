"""Leakage-safe features: a feature at a date never depends on y at or after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..grain import Grain

EXOG = ("item_id", "dept_id", "cat_id", "store_id", "state_id", "wday", "month", "year", "weekofyear", "event_name_1", "event_type_1", "event_name_2", "event_type_2", "snap", "price")
CATEGORICAL = ("item_id", "dept_id", "cat_id", "store_id", "state_id", "event_name_1", "event_type_1", "event_name_2", "event_type_2")


def build(panel: DataFrame, grain: Grain) -> DataFrame:
    """Lags, trailing means, deviations and zero rates, price change.

    One shuffle by series serves every window. A trailing window counts a
    missing first value as non-zero, as the zero test is false for it.
    """
    w = Window.partitionBy("series_id").orderBy("date")
    out = panel.withColumn("_before", F.lag("y", 1).over(w))
    cols = [F.lag("y", k).over(w).alias(f"lag_{k}") for k in grain.lags]
    for n in grain.windows:
        past, shifted = w.rowsBetween(-n, -1), w.rowsBetween(-(n - 1), 0)
        cols.append(F.avg("y").over(past).alias(f"roll_mean_{n}"))
        cols.append(F.stddev_samp("y").over(past).alias(f"roll_std_{n}"))
        cols.append(F.avg(F.coalesce((F.col("_before") == 0).cast("double"), F.lit(0.0))).over(shifted).alias(f"roll_zero_rate_{n}"))
    if "price" in panel.columns:
        cols.append((F.col("price") / F.nullif(F.lag("price", grain.price_lag).over(w), F.lit(0.0)) - 1).alias("price_change"))
    return out.select("*", *cols).drop("_before")


def columns(df: DataFrame, grain: Grain) -> list[str]:
    """Feature columns that the table has."""
    made = [f"lag_{k}" for k in grain.lags] + [f"roll_{kind}_{n}" for n in grain.windows for kind in ("mean", "std", "zero_rate")] + ["price_change"]
    return [c for c in [*made, *EXOG] if c in df.columns]


def categorical(df: DataFrame) -> list[str]:
    return [c for c in CATEGORICAL if c in df.columns]
