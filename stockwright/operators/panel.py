"""The dense weekly panel: units, unit values, spine, selection and its EDA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mathx import corr
from ..functions.ranks import ranks

OUTLIER = 10.0


def spine(lines: DataFrame, days: int = 7) -> DataFrame:
    """(series_id, date): every series at every period from first to last."""
    ends = lines.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))  # one row
    series = lines.select("series_id").distinct()
    return series.join(F.broadcast(ends)).select("series_id", F.explode(F.expr(f"sequence(lo, hi, interval {days} days)")).alias("date"))


def weekly_units(lines: DataFrame) -> DataFrame:
    """(series_id, date, y): zero where nothing sold."""
    sold = lines.groupBy("series_id", F.col("week").alias("date")).agg(F.sum("units").alias("y"))
    return spine(lines).join(sold, ["series_id", "date"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def near_median(lines: DataFrame, outlier: float = OUTLIER) -> DataFrame:
    """lines with near: the line price, null beyond ``outlier`` times the
    series' median either way."""
    middle = lines.groupBy("series_id").agg(F.median("unit_price").alias("middle"))
    x = F.col("unit_price") / F.nullif("middle", F.lit(0.0))
    return lines.join(middle, "series_id").withColumn("near", F.when(x.between(1 / outlier, outlier), F.col("unit_price"))).drop("middle")


def unit_values(lines: DataFrame, outlier: float = OUTLIER) -> DataFrame:
    """(series_id, date, price): median line price of the week, without lines
    beyond ``outlier`` times the series' median either way."""
    return near_median(lines, outlier).groupBy("series_id", F.col("week").alias("date")).agg(F.median("near").alias("price"))


def carry(panel: DataFrame, column: str = "price") -> DataFrame:
    """Carry a value forward over gaps, and backward before the first."""
    w = Window.partitionBy("series_id").orderBy("date")
    ahead = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return panel.withColumn(column, F.coalesce(ahead, back))


def build(lines: DataFrame) -> DataFrame:
    """(series_id, date, y, price) from (series_id, week, units, unit_price)."""
    return carry(weekly_units(lines).join(unit_values(lines), ["series_id", "date"], "left"))


def active_series(panel: DataFrame, first_weeks: int = 52, least: int = 13) -> DataFrame:
    """(series_id, active_weeks): sold in at least ``least`` of the first weeks."""
    start = panel.agg(F.min("date").alias("d0"))
    early = panel.join(F.broadcast(start)).where(F.col("date") < F.date_add("d0", 7 * first_weeks))
    return early.groupBy("series_id").agg(F.count_if(F.col("y") > 0).alias("active_weeks")).where(F.col("active_weeks") >= least)


def closed_weeks(panel: DataFrame, share: float = 0.05) -> DataFrame:
    """(date, total): weeks whose total is under a share of the median week."""
    total = panel.groupBy("date").agg(F.sum("y").alias("total"))
    return total.join(F.broadcast(total.agg(F.median("total").alias("m")))).where(F.col("total") < share * F.col("m")).select("date", "total")


def zero_shares(panel: DataFrame, half: int = 52, tail: int = 13) -> DataFrame:
    """One row: share of empty cells in all, open, year 1 and year 2 weeks,
    quartiles over series, silent series, mean and median of non-empty cells."""
    closed = closed_weeks(panel).select("date", F.lit(True).alias("closed"))
    ends = panel.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    p = panel.join(closed, "date", "left").join(F.broadcast(ends))
    zero = (F.col("y") == 0).cast("double")
    early = F.col("date") < F.date_add("d0", 7 * half)
    of_open = F.when(F.col("closed").isNull(), zero)
    per = p.groupBy("series_id").agg(F.avg(of_open).alias("share"), F.max(F.when(F.col("date") > F.date_sub("d1", 7 * tail), F.col("y"))).alias("late"))
    spread = per.agg(F.percentile("share", F.lit(0.25)).alias("q25"), F.percentile("share", F.lit(0.5)).alias("q50"), F.percentile("share", F.lit(0.75)).alias("q75"), F.count_if(F.col("late") <= 0).alias("silent"), F.count(F.lit(1)).alias("n_series"))
    sold = F.when(F.col("y") > 0, F.col("y"))
    whole = p.agg(F.avg(zero).alias("all_weeks"), F.avg(of_open).alias("open_weeks"), F.avg(F.when(early, zero)).alias("year_1"), F.avg(F.when(~early, zero)).alias("year_2"), F.avg(sold).alias("mean_nonzero"), F.median(sold).alias("median_nonzero"))
    return whole.join(F.broadcast(spread))


def bulk_weeks(panel: DataFrame, lines: DataFrame, top: int = 12) -> DataFrame:
    """The largest cells: their largest line's share and size against the
    series' median non-empty week."""
    largest = lines.groupBy("series_id", F.col("week").alias("date")).agg(F.max("units").alias("largest_line"), F.count(F.lit(1)).alias("n_lines"))
    typical = panel.where("y > 0").groupBy("series_id").agg(F.median("y").alias("typical"))
    cells = panel.orderBy(F.desc("y"), "series_id", "date").limit(top)
    out = cells.join(largest, ["series_id", "date"], "left").join(typical, "series_id", "left")
    return out.select("series_id", "date", "y", "largest_line", "n_lines", (F.col("largest_line") / F.col("y")).alias("largest_share"), (F.col("y") / F.col("typical")).alias("x_typical"))


def concentration(panel: DataFrame, lines: DataFrame, large: float = 1000.0) -> DataFrame:
    """One row: share of units in the top 1 % of non-empty cells and in lines
    of at least ``large`` units."""
    sold = panel.where("y > 0")
    placed = ranks(sold.select("y"), [], [F.desc("y")], "place", "n")
    top = F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    cells = placed.agg((F.sum(F.when(top, F.col("y"))) / F.sum("y")).alias("top_1pct_share"))
    of_lines = lines.agg((F.sum(F.when(F.col("units") >= large, F.col("units")).otherwise(0.0)) / F.sum("units")).alias("large_line_share"))
    return cells.join(F.broadcast(of_lines))


def selection_effect(panel: DataFrame, least: int = 13, half: int = 52) -> DataFrame:
    """Totals of the first two years, growth and seasonal peak ratio for all,
    selected and unselected series."""
    chosen = active_series(panel, half, least).select("series_id", F.lit(True).alias("selected"))
    start = panel.agg(F.min("date").alias("d0"))
    p = panel.join(chosen, "series_id", "left").join(F.broadcast(start)).withColumn("year", (F.datediff("date", "d0") / (7 * half)).cast("int") + 1).where("year <= 2")
    named = p.select("*", F.explode(F.array(F.lit("all"), F.when(F.col("selected"), F.lit("selected")).otherwise(F.lit("not selected")))).alias("group"))
    weekly = named.groupBy("group", "year", "date").agg(F.sum("y").alias("total"))
    month = F.month("date")
    autumn, spring = F.avg(F.when(month.between(9, 11), F.col("total"))), F.avg(F.when(month.between(3, 7), F.col("total")))
    yearly = weekly.groupBy("group", "year").agg(F.sum("total").alias("units"), (autumn / F.nullif(spring, F.lit(0.0))).alias("peak"))
    at = lambda c, y: F.max(F.when(F.col("year") == y, F.col(c)))
    out = yearly.groupBy("group").agg(at("units", 1).alias("units_1"), at("units", 2).alias("units_2"), at("peak", 1).alias("peak_1"), at("peak", 2).alias("peak_2"))
    return out.withColumn("growth", F.col("units_2") / F.nullif("units_1", F.lit(0.0)))


def monthly_share(panel: DataFrame) -> DataFrame:
    by = panel.groupBy(F.month("date").alias("month")).agg(F.sum("y").alias("units"))
    return by.join(F.broadcast(by.agg(F.sum("units").alias("whole")))).select("month", (F.col("units") / F.col("whole")).alias("share"))


def weekday_share(lines: DataFrame) -> DataFrame:
    """Share of units by weekday, Saturday = 1 … Friday = 7."""
    by = lines.groupBy((F.pmod(F.weekday("day") + 2, F.lit(7)) + 1).cast("int").alias("wday")).agg(F.sum("units").alias("units"))
    return by.join(F.broadcast(by.agg(F.sum("units").alias("whole")))).select("wday", (F.col("units") / F.col("whole")).alias("share"))


def price_correlation(panel: DataFrame) -> DataFrame:
    """Per series: correlation of price and units, where both move."""
    both = panel.groupBy("series_id").agg(corr(F.col("price"), F.col("y")).alias("r"), F.var_samp("price").alias("vp"), F.var_samp("y").alias("vy"))
    return both.select("series_id", F.when((F.col("vp") > 1e-12) & (F.col("vy") > 1e-12), F.col("r")).alias("r"))


def late_starters(panel: DataFrame, after: int = 26) -> DataFrame:
    """(series_id, first_sale): series that first sold after so many weeks."""
    ends = panel.agg(F.min("date").alias("d0"))
    first = panel.where("y > 0").groupBy("series_id").agg(F.min("date").alias("first_sale"))
    return first.join(F.broadcast(ends)).where(F.datediff("first_sale", "d0") > 7 * after).select("series_id", "first_sale")
