"""Wide daily sales with calendar and prices as the canonical panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
CALENDAR = "date DATE, wm_yr_wk INT, weekday STRING, wday INT, month INT, year INT, d STRING, event_name_1 STRING, event_type_1 STRING, event_name_2 STRING, event_type_2 STRING, snap_CA INT, snap_TX INT, snap_WI INT"
PRICES = "store_id STRING, item_id STRING, wm_yr_wk INT, sell_price DOUBLE"


def panel(sales: DataFrame, calendar: DataFrame, prices: DataFrame, stores: Sequence[str] | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """One row per series and day. Filters reach the wide table before it is
    unpivoted; the calendar has one row a day and is broadcast."""
    if stores:
        sales = sales.where(F.col("store_id").isin(list(stores)))
    if categories:
        sales = sales.where(F.col("cat_id").isin(list(categories)))
    days = [c for c in sales.columns if c.startswith("d_")]
    long = sales.unpivot(list(IDS), days, "d", "units")
    j = long.join(F.broadcast(calendar), "d", "left").join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
    snap = F.when(F.col("state_id") == "CA", F.col("snap_CA")).when(F.col("state_id") == "TX", F.col("snap_TX")).when(F.col("state_id") == "WI", F.col("snap_WI")).otherwise(0)
    return j.select(F.concat_ws("_", "item_id", "store_id").alias("series_id"), "date", F.col("units").cast("double").alias("y"), F.col("sell_price").alias("price"), *IDS[1:], "wday", "month", "year", "event_name_1", "event_type_1", "event_name_2", "event_type_2", snap.alias("snap"))


def read(spark: SparkSession, folder: str, stores: Sequence[str] | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """From the three CSV files of the public competition."""
    csv = lambda name, schema=None: (spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)).option("header", True).csv(f"{folder}/{name}.csv")
    return panel(csv("sales_train_validation"), csv("calendar", CALENDAR), csv("sell_prices", PRICES), stores, categories)
