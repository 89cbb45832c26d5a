"""From forecasts to reorder points, order-up-to levels and order quantities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import percentiles, ranks
from ..functions.mathx import Z90, cut_rank, loss_of, norm_cdf, ratio, standard_loss, z
from .metrics import bucket

FORMS = ("normal", "empirical")
GRANULARITIES = ("intermittency", "volume_tercile_within_intermittency", "volume_quintile")


def _total(value: Column) -> Column:
    """Sum that is missing if any term is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def lead_time_stats(cache: DataFrame, lead: int, keys: tuple[str, ...] = ("fold", "model", "series_id")) -> DataFrame:
    """(keys, mean, std) of demand over the first ``lead`` steps."""
    d = (F.col("p90") - F.col("p10")) / (2 * Z90)
    g = cache.where(F.col("step") <= lead).groupBy(*keys)
    return g.agg(_total(F.col("p50")).alias("mean"), F.sqrt(_total(d * d)).alias("std"))


def lead_time_residuals(cache: DataFrame, lead: int, keys: tuple[str, ...] = ("fold", "model", "series_id")) -> DataFrame:
    """(keys, residual): realised less forecast demand; missing demand is zero."""
    g = cache.where(F.col("step") <= lead).groupBy(*keys)
    return g.agg((F.coalesce(F.sum("y"), F.lit(0.0)) - F.sum("p50")).alias("residual"))


def pooled_sigma(residuals: DataFrame, stats: DataFrame) -> DataFrame:
    """(fold, model, series_id, sigma): sample deviation of residuals in the
    series' intermittency bucket, else over all series."""
    r = residuals.join(stats, ["fold", "series_id"], "left").withColumn("bucket", bucket(F.col("zero_rate")))
    every = r.groupBy("fold", "model").agg(F.stddev_samp("residual").alias("every"))
    part = r.groupBy("fold", "model", "bucket").agg(F.stddev_samp("residual").alias("part"))
    out = r.join(part, ["fold", "model", "bucket"]).join(every, ["fold", "model"])
    return out.select("fold", "model", "series_id", F.coalesce("part", "every").alias("sigma"))


# --------------------------------------------------------------- safety stock


def volume_part(rank: Column, n: Column, parts: int) -> Column:
    """Part (from 1) of a rank by volume; one series alone is in the middle."""
    return F.when(n > 1, cut_rank(rank, n, parts)).otherwise(parts // 2 + 1)


def assign_buckets(stats: DataFrame, granularity: str, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """stats (keys, series_id, zero_rate, volume) with a column bucket. Volume
    cuts rank all series of a fold, ties by series_id; one series alone is in
    the middle part."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"no granularity {granularity!r}; there are {', '.join(GRANULARITIES)}")
    kind = bucket(F.col("zero_rate"))
    if granularity == "intermittency":
        return stats.withColumn("bucket", kind)
    parts, names = (5, ["q1", "q2", "q3", "q4", "q5"]) if granularity == "volume_quintile" else (3, ["lo", "mid", "hi"])
    n, rank = F.col("_n"), F.col("_rank")
    placed = ranks(stats, keys, [F.col("volume"), F.col("series_id")], "_rank", "_n")
    label = F.element_at(F.array(*[F.lit(x) for x in names]), volume_part(rank, n, parts))
    return placed.withColumn("bucket", label if parts == 5 else F.concat(kind, F.lit("_"), label)).drop("_rank", "_n")


def _buffer(level: float, form: str) -> Column:
    if form not in FORMS:
        raise ValueError(f"no form {form!r}; there are {', '.join(FORMS)}")
    return F.lit(z(level)) * F.stddev_samp("residual") if form == "normal" else F.lit(None).cast("double")


def _with_quantile(table: DataFrame, rows: DataFrame, keys: list[str], level: float, form: str, name: str) -> DataFrame:
    """The empirical buffer, an exact quantile that no task gathers."""
    if form == "normal":
        return table
    return table.drop(name).join(percentiles(rows, keys, "residual", {name: level}), keys, "left")


def bucket_safety_stock(residuals: DataFrame, buckets: DataFrame, level: float, form: str = "normal") -> DataFrame:
    """(fold, model, bucket, n, std, safety_stock)."""
    r = residuals.join(buckets.select("fold", "series_id", "bucket"), ["fold", "series_id"])
    table = r.groupBy("fold", "model", "bucket").agg(F.count("residual").alias("n"), F.stddev_samp("residual").alias("std"), _buffer(level, form).alias("safety_stock"))
    return _with_quantile(table, r, ["fold", "model", "bucket"], level, form, "safety_stock")


def series_safety_stock(residuals: DataFrame, buckets: DataFrame, level: float, form: str = "normal") -> DataFrame:
    """(fold, model, series_id, bucket, safety_stock): the bucket's buffer, the
    pooled one where the bucket has none."""
    table = bucket_safety_stock(residuals, buckets, level, form).select("fold", "model", "bucket", "safety_stock")
    every = _with_quantile(residuals.groupBy("fold", "model").agg(_buffer(level, form).alias("every")), residuals, ["fold", "model"], level, form, "every")
    r = residuals.join(buckets.select("fold", "series_id", "bucket"), ["fold", "series_id"])
    out = r.join(table, ["fold", "model", "bucket"], "left").join(every, ["fold", "model"], "left")
    return out.select("fold", "model", "series_id", "bucket", F.coalesce("safety_stock", "every").alias("safety_stock"))


def residual_spread(residuals: DataFrame) -> DataFrame:
    """(model, series_id, std): deviation of a series' residuals over folds."""
    return residuals.groupBy("model", "series_id").agg(F.stddev_samp("residual").alias("std"))


def within_bucket(spread: DataFrame, buckets: DataFrame) -> DataFrame:
    """(model, bucket, n, p10, median, p90, max, p90_over_p10)."""
    s = spread.join(buckets.select("series_id", "bucket"), "series_id").where("std IS NOT NULL")
    g = s.groupBy("model", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("std").alias("max"))
    g = g.join(percentiles(s, ["model", "bucket"], "std", {"p10": 0.1, "median": 0.5, "p90": 0.9}), ["model", "bucket"]).select("model", "bucket", "n", "p10", "median", "p90", "max")
    return g.withColumn("p90_over_p10", ratio(F.col("p90"), F.col("p10")))


# ------------------------------------------------------------------- policies


def csl_policy(stats: DataFrame, target: float) -> DataFrame:
    """Cycle service level: safety stock z times the deviation."""
    return stats.withColumn("safety_stock", F.lit(z(target)) * F.col("std")).withColumn("reorder_point", F.col("mean") + F.col("safety_stock"))


def fill_rate_k(target: float, quantity: Column, sigma: Column, steps: int = 60) -> Column:
    """Safety factor that fills the target share of demand: the root of
    G(k) = (1 - target) Q / sigma on [-6, 6], by bisection in one expression."""
    if not 0 < target < 1:
        raise ValueError("target fill rate must be between 0 and 1")
    need = (1 - target) * quantity / F.nullif(sigma, F.lit(0.0))
    start = F.struct(F.lit(-6.0).alias("lo"), F.lit(6.0).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        over = standard_loss(mid) > need
        return F.struct(F.when(over, mid).otherwise(a["lo"]).alias("lo"), F.when(over, a["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2)
    bounded = F.when(need >= standard_loss(F.lit(-6.0)), F.lit(-6.0)).when(need <= standard_loss(F.lit(6.0)), F.lit(6.0)).otherwise(root)
    return F.when((sigma > 0) & (quantity > 0), bounded).otherwise(F.lit(0.0))


def fill_rate_factors(target: float, quantity: np.ndarray, sigma: np.ndarray, steps: int = 60) -> np.ndarray:
    """``fill_rate_k`` of whole arrays."""
    if not 0 < target < 1:
        raise ValueError("target fill rate must be between 0 and 1")
    rows = np.flatnonzero((sigma > 0) & (quantity > 0))
    need, back = np.unique((1 - target) * quantity[rows] / sigma[rows], return_inverse=True)
    lo, hi = np.full(len(need), -6.0), np.full(len(need), 6.0)
    for _ in range(steps):
        mid = (lo + hi) / 2
        over = loss_of(mid) > need
        lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
    ends = loss_of(np.array([-6.0, 6.0]))
    root = np.where(need >= ends[0], -6.0, np.where(need <= ends[1], 6.0, (lo + hi) / 2))
    out = np.zeros(len(quantity))
    out[rows] = root[back]
    return out


def fill_rate_policy(stats: DataFrame, target: float) -> DataFrame:
    k = fill_rate_k(target, F.col("mean"), F.col("std"))
    return stats.withColumn("k", k).withColumn("safety_stock", F.col("k") * F.col("std")).withColumn("reorder_point", F.col("mean") + F.col("safety_stock"))


POLICIES: dict[str, Callable[[DataFrame, float], DataFrame]] = {"csl": csl_policy, "fill_rate": fill_rate_policy}


def order_quantity(s: Column, on_hand: Column, up_to: Column | None = None) -> Column:
    if up_to is None:
        return F.greatest(s - on_hand, F.lit(0.0))
    return F.when(on_hand < s, F.greatest(up_to - on_hand, F.lit(0.0))).otherwise(F.lit(0.0))


def stockout_probability(on_hand: Column, mean: Column, std: Column) -> Column:
    certain = F.when(on_hand >= mean, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(std == 0, certain).otherwise(1 - norm_cdf((on_hand - mean) / F.nullif(std, F.lit(0.0))))


def rationale(on_hand: Column, mean: Column, lead: int, level: float, quantity: Column, unit: str = "days") -> Column:
    rate = mean / lead
    covers = F.when(rate == 0, F.lit("inf")).otherwise(F.format_string("%.1f", on_hand / F.nullif(rate, F.lit(0.0))))
    action = F.when(quantity > 0, F.format_string("order %.0f units", quantity)).otherwise(F.lit("no order needed"))
    share = f"{level:.0%}".replace("%", "%%")
    pattern = f" {unit} of expected demand (%.1f/{unit[:-1]}); lead time is {lead} {unit} at {share}"
    return F.concat(F.format_string("On-hand (%.0f) covers ", on_hand), covers, F.format_string(pattern, rate), F.lit(" service level → "), action, F.lit("."))


def decide(stats: DataFrame, level: float, lead: int, buffers: DataFrame | None = None, lot: float = 0.0, keys: tuple[str, ...] = ("series_id",), unit: str = "days") -> DataFrame:
    """Full decision per row of stats (keys, mean, std, on_hand). Calibrated
    buffers (keys, safety_stock) replace z times std where a series has one, and
    then imply the deviation of the stock-out probability."""
    zl = z(level)
    out = stats
    quantile = F.lit(zl) * F.col("std")
    if buffers is None:
        out = out.withColumn("safety_stock", quantile)
    else:
        out = out.join(buffers.withColumnRenamed("safety_stock", "_b"), list(keys), "left").withColumn("safety_stock", F.coalesce("_b", quantile)).drop("_b")
        if zl > 0:
            out = out.withColumn("std", F.col("safety_stock") / zl)
    out = out.withColumn("reorder_point", F.col("mean") + F.col("safety_stock"))
    out = out.withColumn("order_up_to", F.col("reorder_point") + lot * F.greatest(F.col("mean"), F.lit(0.0)))
    out = out.withColumn("order_quantity", order_quantity(F.col("reorder_point"), F.col("on_hand"), F.col("order_up_to") if lot else None))
    out = out.withColumn("stockout_probability", stockout_probability(F.col("on_hand"), F.col("mean"), F.col("std")))
    return out.withColumn("rationale", rationale(F.col("on_hand"), F.col("mean"), lead, level, F.col("order_quantity"), unit))
