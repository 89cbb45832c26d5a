"""Prices of stock and lost sales, and exact re-pricing of stored runs."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import ratio
from ..grain import Grain

HOLDING, MARGIN, LEVEL, LOT = 0.25, 0.275, 0.95, 2.0


@dataclass(frozen=True)
class Costs:
    """Annual holding rate on unit cost; lost sales cost the margin, or a flat
    penalty where there is no margin (then stock is valued at price)."""

    holding_rate: float = HOLDING
    margin: float | None = MARGIN
    flat_penalty: float = 5.0

    def unit_cost(self, price: Column) -> Column:
        return price if self.margin is None else price * (1 - self.margin)

    def penalty(self, price: Column) -> Column:
        return F.lit(float(self.flat_penalty)) if self.margin is None else price * self.margin

    def stamp(self, rows: DataFrame, grain: Grain) -> DataFrame:
        """Mark rows with what they were priced under."""
        return rows.withColumn("rate_used", F.lit(grain.period_rate(self.holding_rate))).withColumn("margin_used", F.lit(self.margin).cast("double")).withColumn("penalty_used", F.lit(float(self.flat_penalty)))


@dataclass(frozen=True)
class Config:
    costs: Costs
    lead: int
    level: float = LEVEL
    lot: float = LOT


def load_config(grain: Grain, env: dict[str, str] | None = None) -> Config:
    """Configuration from environment variables; a margin and a flat penalty
    exclude each other."""
    e = os.environ if env is None else env
    if "GROSS_MARGIN" in e and "STOCKOUT_PENALTY_PER_UNIT" in e:
        raise ValueError("set GROSS_MARGIN or STOCKOUT_PENALTY_PER_UNIT, not both")
    costs = Costs(float(e.get("HOLDING_COST_RATE", HOLDING)), float(e.get("GROSS_MARGIN", MARGIN)))
    if "STOCKOUT_PENALTY_PER_UNIT" in e:
        costs = replace(costs, margin=None, flat_penalty=float(e["STOCKOUT_PENALTY_PER_UNIT"]))
    lead = int(e.get("LEAD_TIME_PERIODS", e.get("LEAD_TIME_DAYS", grain.lead_time)))
    return Config(costs, lead, float(e.get("SERVICE_LEVEL_TARGET", LEVEL)), float(e.get("LOT_MULTIPLE", LOT)))


def one_rate(rows: DataFrame) -> float:
    """The period rate that all rows were priced at; mixed stamps raise."""
    lo, hi = rows.agg(F.min("rate_used"), F.max("rate_used")).first()
    if lo is None or lo != hi:
        raise ValueError(f"rows were priced at different holding rates: {lo} to {hi}")
    return lo


def reprice(rows: DataFrame, new: Costs, grain: Grain) -> DataFrame:
    """Stored rows under other economics, exactly: holding cost is linear in
    rate and unit cost, lost-sale cost in the penalty, row by row."""
    price, used = F.col("unit_price"), F.col("margin_used")
    cost_used = F.when(used.isNull(), price).otherwise(price * (1 - used))
    pen_used = F.when(used.isNull(), F.col("penalty_used")).otherwise(price * used)
    holding = F.col("holding_cost") * (F.lit(grain.period_rate(new.holding_rate)) / F.col("rate_used")) * ratio(new.unit_cost(price), cost_used)
    out = rows.withColumn("holding_cost", holding).withColumn("stockout_cost", F.col("stockout_cost") * ratio(new.penalty(price), pen_used))
    return new.stamp(out.withColumn("total_cost", F.col("holding_cost") + F.col("stockout_cost")), grain)


def with_prices(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach (fold, series_id) -> unit_price; a missing or repeated price raises."""
    out = rows.join(prices, ["fold", "series_id"], "left")
    several = prices.groupBy("fold", "series_id").count().where("count > 1")
    if not several.isEmpty() or not out.where("unit_price IS NULL").isEmpty():
        raise ValueError("every (fold, series_id) needs exactly one price")
    return out


def components(rows: DataFrame, keys: tuple[str, ...] = ("lot_multiple",)) -> DataFrame:
    """(keys, model, holding_per_rate, stockout): fold means of the two parts
    of cost; cost at an annual rate h is holding_per_rate * h + stockout."""
    per = rows.groupBy(*keys, "model", "fold").agg(F.sum(F.col("stocked") * F.col("unit_price") * F.coalesce(1 - F.col("margin_used"), F.lit(1.0))).alias("value"), F.sum("stockout_cost").alias("stockout"))
    return per.groupBy(*keys, "model").agg(F.avg("value").alias("value"), F.avg("stockout").alias("stockout"))


def with_rate(parts: DataFrame, grain: Grain) -> DataFrame:
    return parts.withColumn("holding_per_rate", F.col("value") / grain.periods_per_year).drop("value")


def breakevens(parts: DataFrame, keys: tuple[str, ...] = ("lot_multiple",)) -> DataFrame:
    """Per pair of models: the annual rate at which they cost the same (missing
    unless positive), and which is cheaper below it."""
    a = parts.select(*keys, F.col("model").alias("a"), F.col("holding_per_rate").alias("ha"), F.col("stockout").alias("sa"))
    b = parts.select(*keys, F.col("model").alias("b"), F.col("holding_per_rate").alias("hb"), F.col("stockout").alias("sb"))
    p = a.join(b, list(keys)).where("a < b")
    rate = ratio(F.col("sb") - F.col("sa"), F.col("ha") - F.col("hb"))
    below = F.when(F.col("sa") < F.col("sb"), F.col("a")).when(F.col("sb") < F.col("sa"), F.col("b"))
    return p.select(*keys, "a", "b", F.when(rate > 0, rate).alias("rate"), below.alias("cheaper_below"))


def penalty_for(parts: DataFrame, rate: float, keys: tuple[str, ...] = ("lot_multiple",)) -> DataFrame:
    """Per pair: factor on lost-sale cost that puts the crossing at a rate."""
    p = breakevens(parts, keys).where("rate IS NOT NULL")
    return p.select(*keys, "a", "b", (F.lit(rate) / F.col("rate")).alias("penalty_factor"))


def curve(parts: DataFrame, rates: list[float]) -> DataFrame:
    grid = parts.sparkSession.createDataFrame([(float(r),) for r in rates], "rate double")
    return parts.join(F.broadcast(grid)).withColumn("cost", F.col("holding_per_rate") * F.col("rate") + F.col("stockout"))


def crossover(kappa: float, margin: float) -> float:
    """Rate of equal cost as a function of margin: kappa m / (1 - m)."""
    return kappa * margin / (1 - margin)


def critical_ratio(rows: DataFrame, grain: Grain, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """(keys, p10, median, p90) of Cu / (Cu + Co) per series: Cu is the penalty
    of a lost unit, Co the cost of holding one over the realised cycle (the
    window, where a series placed no order)."""
    price = F.col("unit_price")
    cu = F.when(F.col("margin_used").isNull(), F.col("penalty_used")).otherwise(price * F.col("margin_used"))
    length = F.col("n_periods") / F.greatest(F.col("orders"), F.lit(1))
    co = F.col("rate_used") * F.when(F.col("margin_used").isNull(), price).otherwise(price * (1 - F.col("margin_used"))) * length
    r = rows.withColumn("cr", ratio(cu, cu + co))
    return r.groupBy(*keys).agg(*[F.percentile("cr", F.lit(q)).alias(n) for q, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))])


def cycle_length(rows: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.sum("n_periods").alias("n"), F.sum("orders").alias("o"))
    return g.select(*keys, (F.col("n") / F.nullif("o", F.lit(0))).alias("periods"))


def implied_ordering_cost(rows: DataFrame, grain: Grain, keys: tuple[str, ...] = ("model", "lot_multiple")) -> DataFrame:
    """Median K = Q^2 h c / (2 d): the cost of ordering that would make the
    realised quantity the economic one."""
    q, d = F.col("qty") / F.nullif("orders", F.lit(0)), F.col("demanded") / F.col("n_periods")
    cost = F.when(F.col("margin_used").isNull(), F.col("unit_price")).otherwise(F.col("unit_price") * (1 - F.col("margin_used")))
    r = rows.withColumn("k", ratio(q * q * F.col("rate_used") * cost, 2 * d))
    return r.groupBy(*keys).agg(F.median("k").alias("median_k"), F.count("k").alias("n"))
