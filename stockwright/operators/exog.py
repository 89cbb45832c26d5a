"""Calendar and price columns for future periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..grain import Grain

TEMPLATE = 7


def future(panel: DataFrame, horizon: int, grain: Grain, template: int = TEMPLATE) -> DataFrame:
    """Each series' last ``template`` rows, repeated over the horizon after the
    panel's last date; weekday, month and year are those of the new dates."""
    w = Window.partitionBy("series_id").orderBy(F.desc("date"))
    last = panel.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= template)
    size = last.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    end = panel.agg(F.max("date").alias("_end"))
    steps = panel.sparkSession.range(horizon).select(F.col("id").cast("int").alias("_h"))
    t = last.join(size, "series_id").withColumn("_i", F.col("_n") - F.col("_back"))
    out = t.join(F.broadcast(steps), F.col("_h") % F.col("_n") == F.col("_i")).join(F.broadcast(end))
    out = out.withColumn("date", grain.shift(F.col("_end"), F.col("_h") + 1))
    if "wday" in panel.columns:
        out = out.withColumn("wday", (F.pmod(F.weekday("date") + 2, F.lit(7)) + 1).cast("int"))
    for c, f in (("month", F.month), ("year", F.year), ("weekofyear", F.weekofyear)):
        if c in panel.columns:
            out = out.withColumn(c, f("date"))
    return out.drop("_back", "_n", "_i", "_end", "_h", "y")
