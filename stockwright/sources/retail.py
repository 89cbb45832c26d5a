"""Invoice workbooks: sheets read as text keys and stacked with their label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "invoice STRING, stock_code STRING, description STRING, quantity DOUBLE, invoice_date TIMESTAMP, price_gbp DOUBLE, customer STRING, country STRING"


def read_sheets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """sheet label -> CSV file or folder; keys stay strings."""
    out = None
    for sheet, path in paths.items():
        one = spark.read.schema(LINES).option("header", True).csv(path).withColumn("sheet", F.lit(sheet))
        out = one if out is None else out.unionByName(one)
    return out
