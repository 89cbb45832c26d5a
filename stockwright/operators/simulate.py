"""The (s, S) lost-sales simulator, stepping all rows of a batch at once.

Per period, in this order: a due order arrives and closes its cycle; demand is
met from stock, the rest is lost; costs are booked; an order up to S is placed if
stock is below s and none is on its way. Stock and lost units are summed
unpriced: the trajectory never depends on prices, so one run serves all economics.

The same pass labels stock-out cycles: a *sizing* failure when demand between
order and arrival exceeds s, an *undershoot* otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import ratio
from ..grain import Grain
from .economics import Costs

#: Decimals of s, S and the start: both engines of a check must see equal ones.
PLACES = 6


COUNTS = ("cycles", "stockouts", "sizing", "orders", "small")
AMOUNTS = ("shipped", "demanded", "lost", "stocked", "qty", "qty_sq")


def steps(demand: np.ndarray, s: np.ndarray, up_to: np.ndarray, start: np.ndarray, lead: int, wanted: Sequence[str] = (*COUNTS, *AMOUNTS)) -> dict[str, np.ndarray]:
    """Totals of policies over rows of demand: all rows take a period at once.
    Only those wanted are added up."""
    n = len(demand)
    stock, coming, exposure = start.astype(float), np.zeros(n), np.zeros(n)
    due, short = np.full(n, -1), np.zeros(n, bool)
    out = {c: np.zeros(n, np.int32) for c in COUNTS if c in wanted} | {c: np.zeros(n) for c in AMOUNTS if c in wanted}
    causes, quantities = "sizing" in wanted, "qty" in wanted or "qty_sq" in wanted or "small" in wanted
    for t, d in enumerate(np.ascontiguousarray(demand.T)):
        arrives = due == t
        waiting = ~arrives & (due >= 0)
        stock = stock + np.where(arrives, coming, 0.0)
        failed = arrives & short
        sold = np.minimum(stock, d)
        lost, stock = d - sold, stock - sold
        places = ~waiting & (stock < s) & (up_to - stock > 0)
        q = np.where(places, up_to - stock, 0.0)
        found = {"cycles": arrives, "stockouts": failed, "shipped": sold, "demanded": d, "lost": lost, "stocked": stock, "orders": places, "qty": q}
        if causes:
            found["sizing"] = failed & (exposure > s + 1e-9)
            exposure = np.where(waiting, exposure + d, 0.0)
        if quantities:
            found |= {"qty_sq": q * q, "small": places & (q < 1)}
        for c in out:
            out[c] += found[c]
        short = waiting & (short | (lost > 0))
        due = np.where(places, t + lead, np.where(waiting, due, -1))
        coming = np.where(places, q, np.where(waiting, coming, 0.0))
    return out


def run(demand: Column, s: Column, up_to: Column, start: Column, lead: int) -> Column:
    """Struct of totals of a policy over an array of demand, whole Arrow batches
    at a time."""
    kinds = [(c, pa.int32()) for c in COUNTS] + [(c, pa.float64()) for c in AMOUNTS]

    @F.arrow_udf(", ".join([f"{c} int" for c in COUNTS] + [f"{c} double" for c in AMOUNTS]))
    def simulate(ds: pa.Array, s_: pa.Array, u_: pa.Array, h_: pa.Array) -> pa.Array:
        size = pa.compute.list_value_length(ds).to_numpy(zero_copy_only=False)
        flat, at = ds.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        args = [x.to_numpy(zero_copy_only=False) for x in (s_, u_, h_)]
        out = {c: np.zeros(len(ds), np.int32 if kind == pa.int32() else float) for c, kind in kinds}
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            found = steps(flat[at[rows][:, None] + np.arange(n)], *[x[rows] for x in args], lead)
            for c, x in found.items():
                out[c][rows] = x
        return pa.StructArray.from_arrays([pa.array(out[c], kind) for c, kind in kinds], [c for c, _ in kinds])

    return simulate(demand, s, up_to, start)


TOTALS = (*COUNTS, *AMOUNTS)


def demands(arrays_: DataFrame, folds_: DataFrame, grain: Grain) -> DataFrame:
    """(fold, series_id, demand): each fold's test window as an array."""
    at = grain.steps(F.col("start"), F.col("test_start"))
    d = arrays_.join(F.broadcast(folds_)).select("fold", "series_id", F.slice("ys", at + 1, grain.horizon).alias("demand"))
    return d.where(F.size("demand") > 0)


def detail(policies: DataFrame, demand: DataFrame, prices: DataFrame, lead: int, lots: tuple[float, ...] = (0.0,), start_fraction: float = 0.5) -> DataFrame:
    """One row per policy row, lot and series. policies has fold, model,
    series_id, mean, std, safety_stock and reorder_point (and any further keys, such as form or target).
    Series with a missing reorder point or no demand are left out. Prices fall
    back to the mean over the fold's series."""
    every = prices.groupBy("fold").agg(F.avg("unit_price").alias("_every"))
    p = policies.where("reorder_point IS NOT NULL").join(demand, ["fold", "series_id"]).join(prices, ["fold", "series_id"], "left").join(F.broadcast(every), "fold", "left")
    p = p.withColumn("unit_price", F.coalesce("unit_price", "_every")).drop("_every")
    p = p.withColumn("lot_multiple", F.explode(F.array(*[F.lit(float(m)) for m in lots])))
    lot = F.col("lot_multiple") * F.greatest(F.col("mean"), F.lit(0.0))
    p = p.withColumn("s", F.round("reorder_point", PLACES)).withColumn("up_to", F.round(F.col("reorder_point") + lot, PLACES)).withColumn("on_hand_start", F.round(F.col("reorder_point") + start_fraction * lot, PLACES))
    p = p.withColumn("n_periods", F.size("demand")).withColumn("r", run(F.col("demand"), F.col("s"), F.col("up_to"), F.col("on_hand_start"), lead))
    return p.select("*", *[F.col(f"r.{c}").alias(c) for c in TOTALS]).drop("demand", "r", "reorder_point").withColumnRenamed("s", "reorder_point").withColumnRenamed("up_to", "order_up_to")


def priced(rows: DataFrame, costs: Costs, grain: Grain) -> DataFrame:
    """With holding_cost, stockout_cost, total_cost, fill_rate, avg_on_hand and
    the stamps of the economics."""
    price = F.col("unit_price")
    r = rows.withColumn("holding_cost", F.lit(grain.period_rate(costs.holding_rate)) * costs.unit_cost(price) * F.col("stocked"))
    r = r.withColumn("stockout_cost", costs.penalty(price) * F.col("lost")).withColumn("total_cost", F.col("holding_cost") + F.col("stockout_cost"))
    r = r.withColumn("fill_rate", F.when(F.col("demanded") > 0, F.col("shipped") / F.nullif("demanded", F.lit(0.0))).otherwise(1.0)).withColumn("avg_on_hand", F.col("stocked") / F.col("n_periods"))
    return costs.stamp(r, grain)


def pooled(rows: DataFrame, keys: tuple[str, ...] = ("fold", "model", "lot_multiple")) -> DataFrame:
    """Sums and pooled ratios of a detail table by key."""
    factor = ratio(F.col("safety_stock"), F.col("std"))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_series"), *[F.sum(c).alias(c) for c in ("holding_cost", "stockout_cost", "total_cost")],
        F.sum("shipped").alias("_shipped"), F.sum("demanded").alias("_demanded"), F.sum("cycles").alias("cycles"), F.sum("stockouts").alias("_stockouts"), F.sum("avg_on_hand").alias("_on_hand"),
        F.sum(factor).alias("_factor"), F.count(factor).alias("_factors"),
    )
    return pooled_sums(g, keys)


def pooled_sums(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The same from sums by key (``runs.SUMS``)."""
    g = sums.withColumn("mean_safety_factor", F.col("_factor") / F.nullif("_factors", F.lit(0)))
    fill = F.when(F.col("_demanded") > 0, F.col("_shipped") / F.nullif("_demanded", F.lit(0.0))).otherwise(1.0)
    g = g.withColumn("fill_rate", fill).withColumn("csl", 1 - F.col("_stockouts") / F.nullif("cycles", F.lit(0))).withColumn("turns", ratio(F.col("_shipped"), F.col("_on_hand")))
    return g.select(*keys, "n_series", "holding_cost", "stockout_cost", "total_cost", "cycles", "mean_safety_factor", "fill_rate", "csl", "turns")


def order_stats(rows: DataFrame, keys: tuple[str, ...] = ("fold", "model", "lot_multiple")) -> DataFrame:
    """Realised order quantities: mean, variation, share below one unit, and
    the median over series of lead-time deviation to mean quantity."""
    per = F.when(F.col("orders") > 0, ratio(F.col("std"), F.col("qty") / F.nullif("orders", F.lit(0))))
    g = rows.groupBy(*keys).agg(F.sum("orders").alias("orders"), F.sum("qty").alias("q"), F.sum("qty_sq").alias("q2"), F.sum("small").alias("small"), F.median(per).alias("sigma_over_q"))
    n = F.nullif("orders", F.lit(0))
    mean = F.col("q") / n
    g = g.withColumn("q_mean", mean).withColumn("q_cv", F.sqrt(F.greatest(F.col("q2") / n - mean * mean, F.lit(0.0))) / F.nullif(mean, F.lit(0.0))).withColumn("q_below_one", F.col("small") / n)
    return g.select(*keys, "orders", "q_mean", "q_cv", "q_below_one", "sigma_over_q")


def decomposition(rows: DataFrame, keys: tuple[str, ...] = ("model", "lot_multiple")) -> DataFrame:
    """Stock-out cycles by cause, and the share of undershoots."""
    g = rows.groupBy(*keys).agg(F.sum("cycles").alias("cycles"), F.sum("stockouts").alias("stockouts"), F.sum("sizing").alias("sizing"))
    g = g.withColumn("undershoot", F.col("stockouts") - F.col("sizing"))
    return g.withColumn("undershoot_share", F.col("undershoot") / F.nullif("stockouts", F.lit(0)))
