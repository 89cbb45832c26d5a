"""Star-schema tables as the canonical panel, invoice lines and forecast log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_of(day: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", day).cast("date")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with series keys: day, week, units, unit_price, brand, type, part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_shipdate").cast("date").alias("day"),
        week_of(F.col("l_shipdate")).alias("week"),
        F.col("l_quantity").alias("units"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("unit_price"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        "l_partkey",
        "l_suppkey",
    )


def series_lines(spark: SparkSession, sf_dir: str, mixed: bool = True) -> DataFrame:
    """(series_id, week, units, unit_price): one series per brand and type, and
    if ``mixed`` one per part, most of whose weeks are empty."""
    s = shipments(spark, sf_dir)
    dense = s.select(F.concat_ws("|", "brand", "type").alias("series_id"), "week", "units", "unit_price")
    if not mixed:
        return dense
    key = F.col("l_partkey").cast("string")
    key = F.when(F.length(key) < 5, F.lpad(key, 5, "0")).otherwise(key)  # lpad alone would cut longer keys
    return dense.unionByName(s.select(F.concat(F.lit("P"), key).alias("series_id"), "week", "units", "unit_price"))


def stock_code(part: Column) -> Column:
    """A part's product code: its last five digits, and what precedes them as up
    to two letters (A to ZZ), so that codes of different parts differ."""
    over = F.floor(part / 100000)
    letter = lambda n: F.char(n + 64)
    suffix = F.when(over == 0, F.lit("")).when(over <= 26, letter(over)).otherwise(F.concat(letter(F.floor((over - 1) / 26)), letter((over - 1) % 26 + 1)))
    return F.concat(F.lpad((part % 100000).cast("string"), 5, "0"), suffix)


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and cancellations: returned lines are cancellations of invoice 'C…'."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    back = F.col("l_returnflag") == "R"
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.when(back, F.lit("C")).otherwise(F.lit("")), F.col("l_orderkey").cast("string")).alias("invoice"),
        F.col("l_linenumber").alias("line"),
        stock_code(F.col("l_partkey")).alias("stock_code"),
        F.col("l_shipdate").cast("timestamp").alias("invoice_date"),
        F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("price_gbp"),
        F.col("o_custkey").cast("string").alias("customer"),
    )


def forecast_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, y, forecast): daily event value; forecast is the day before."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("y"))
    from pyspark.sql.window import Window

    return daily.withColumn("forecast", F.lag("y").over(Window.partitionBy("series_id").orderBy("date"))).where("forecast IS NOT NULL")
