"""Monitoring on an unbounded forecast log.

Row-based windows cannot run on a stream, so trailing errors use windows of
event time; late rows are taken up to the watermark. The batch functions in
``operators.monitor`` stay the definition of record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.monitor import input_drift, realised_error


def errors(log: DataFrame, late: str = "2 days") -> DataFrame:
    return realised_error(log.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late))


def rolling_error(log: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """(series_id, window_start, mae, n) over sliding event-time windows."""
    w = errors(log, late).groupBy(F.window("ts", window, slide).alias("w"), "series_id")
    return w.agg(F.avg("abs_error").alias("mae"), F.count(F.lit(1)).alias("n")).select("series_id", F.col("w.start").cast("date").alias("window_start"), "mae", "n")


def weekly_units(lines: DataFrame, ts: str = "invoice_date", late: str = "7 days") -> DataFrame:
    """(stock_code, week, units): Monday weeks of an invoice stream."""
    w = lines.withWatermark(ts, late).groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("w"), "stock_code")
    return w.agg(F.sum("quantity").alias("units")).select("stock_code", F.col("w.start").cast("date").alias("week"), "units")


def drift_batches(stream: DataFrame, baseline: DataFrame, path: str, checkpoint: str, z: float = 3.0):
    """Write each micro-batch's drifted series; replays overwrite their own batch."""

    def one(batch: DataFrame, epoch: int) -> None:
        input_drift(baseline, batch, z).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def rolling_rows(log: DataFrame, window: int = 7) -> DataFrame:
    """(series_id, date, rolling_mae) over the last rows of each series, kept as
    a ring of at most ``window`` errors in state; rows of a batch are taken in
    order of date."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("date")
        out = []
        for day, y, f in zip(rows["date"], rows["y"], rows["forecast"], strict=True):
            ring = [*ring, abs(y - f)][-window:]
            out.append((key[0], day, sum(ring) / len(ring)))
        state.update((ring,))
        yield pd.DataFrame(out, columns=["series_id", "date", "rolling_mae"])

    return log.groupBy("series_id").applyInPandasWithState(step, "series_id string, date date, rolling_mae double", "ring array<double>", "append", "NoTimeout")


def match_cancellations(sales: DataFrame, cancels: DataFrame, days: int = 90, late: str = "1 day") -> DataFrame:
    """Candidate (sale, cancellation) pairs of two streams: same customer and
    product, sale at most ``days`` before. Watermarks bound the join's state."""
    s = sales.withWatermark("invoice_date", late).alias("s")
    c = cancels.withWatermark("invoice_date", late).alias("c")
    near = (F.col("s.customer") == F.col("c.customer")) & (F.col("s.stock_code") == F.col("c.stock_code")) & (F.col("s.invoice_date") <= F.col("c.invoice_date")) & (F.col("s.invoice_date") >= F.col("c.invoice_date") - F.expr(f"interval {days} days"))
    return s.join(c, near).select(F.col("s.invoice").alias("sale"), F.col("c.invoice").alias("cancellation"), F.col("s.customer").alias("customer"), F.col("s.stock_code").alias("stock_code"), F.col("s.invoice_date").alias("sold_at"), F.col("c.invoice_date").alias("cancelled_at"))
