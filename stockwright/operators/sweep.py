"""Grids of targets, lots and buffer schemes; curves, optima and rules on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mathx import z

#: Service levels of a sweep; those past 99 % keep optima off the grid's edge
#: where holding is cheap (fixed values).
TARGETS = (*(n / 100 for n in range(80, 100)), 0.995, 0.999, 0.9995, 0.9999, 0.99995, 0.99999, 0.999999)
LOTS = (0.0, 0.5, 1.0, 2.0, 4.0)
SCALE = 10**8


def target_id(t: float) -> int:
    """Whole-number key of a target: 99.999 % and 99.9999 % must not collide."""
    return round(t * SCALE)


def targets(spark, grid: Iterable[float] = TARGETS) -> DataFrame:
    return spark.createDataFrame([(target_id(t), float(t), z(t)) for t in grid], "target_id long, target double, z double")


def policies(stats: DataFrame, sigma: DataFrame, grid: DataFrame) -> DataFrame:
    """Reorder points of every target at once: stats (fold, model, series_id,
    mean) with pooled sigma; nothing is forecast again."""
    p = stats.drop("std").join(sigma.withColumnRenamed("sigma", "std"), ["fold", "model", "series_id"]).join(F.broadcast(grid))
    return p.withColumn("safety_stock", F.col("z") * F.col("std")).withColumn("reorder_point", F.col("mean") + F.col("safety_stock")).drop("z")


def curves(rows: DataFrame, keys: tuple[str, ...] = ("target_id", "lot_multiple")) -> DataFrame:
    """Per model and grid point: sums within a fold, ratios, then means over
    folds (in that order)."""
    return curve_of(rows.groupBy(*keys, "model", "fold").agg(*[F.sum(c).alias(c) for c in ("total_cost", "holding_cost", "stockout_cost", "cycles", "stockouts", "shipped", "demanded")]), keys)


def curve_of(sums: DataFrame, keys: tuple[str, ...] = ("target_id", "lot_multiple")) -> DataFrame:
    """``curves`` from the sums of each fold."""
    f = sums.withColumn("csl", 1 - F.col("stockouts") / F.nullif("cycles", F.lit(0))).withColumn("fill", F.col("shipped") / F.nullif("demanded", F.lit(0.0)))
    return f.groupBy(*keys, "model").agg(*[F.avg(c).alias(c) for c in ("total_cost", "holding_cost", "stockout_cost", "csl", "fill")])


def pooled(curve: DataFrame, keys: tuple[str, ...] = ("target_id", "lot_multiple")) -> DataFrame:
    """Means over models of the models' curves."""
    return curve.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("total_cost", "holding_cost", "stockout_cost", "csl", "fill")])


def optimum(curve: DataFrame, by: tuple[str, ...] = ("lot_multiple",), at: str = "target_id", cost: str = "total_cost") -> DataFrame:
    """First least-cost grid point per key, and whether it is on the edge."""
    g = curve.groupBy(*by).agg(F.min(F.struct(cost, at)).alias("b"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    best = F.col(f"b.{at}")
    return g.select(*by, best.alias(at), F.col(f"b.{cost}").alias(cost), ((best == F.col("lo")) | (best == F.col("hi"))).alias("on_edge"))


def nominal_for(curve: DataFrame, csl: float, by: tuple[str, ...] = ("lot_multiple",)) -> DataFrame:
    """Least target whose realised cycle service level reaches one."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("csl") >= csl, F.col("target_id"))).alias("target_id"))


def flat_from(curve: DataFrame, by: tuple[str, ...] = ("lot_multiple",), within: float = 0.02) -> DataFrame:
    """Least target whose cost is within a share of the least cost."""
    least = curve.groupBy(*by).agg(F.min("total_cost").alias("least"))
    return curve.join(least, list(by)).where(F.col("total_cost") <= (1 + within) * F.col("least")).groupBy(*by).agg(F.min("target_id").alias("target_id"))


def nearest(curve: DataFrame, column: str, value: float, by: tuple[str, ...] = ("lot_multiple",)) -> DataFrame:
    """The grid point whose column is nearest to a value."""
    g = curve.groupBy(*by).agg(F.min(F.struct(F.abs(F.col(column) - value).alias("d"), "target_id")).alias("b"))
    return g.select(*by, F.col("b.target_id").alias("target_id"), F.col("b.d").alias("distance"))


def optimal_by_rate(rows: DataFrame, rates: list[float], base: int, periods: int) -> DataFrame:
    """(rate, lot_multiple, target_id, cost, saving, on_edge): the best target
    at each holding rate, against a base target, by linear re-pricing."""
    cost = F.col("unit_price") * F.coalesce(1 - F.col("margin_used"), F.lit(1.0))
    f = rows.groupBy("target_id", "lot_multiple", "model", "fold").agg(F.sum(F.col("stocked") * cost).alias("value"), F.sum("stockout_cost").alias("lost"))
    m = f.groupBy("target_id", "lot_multiple", "model").agg(F.avg("value").alias("value"), F.avg("lost").alias("lost")).groupBy("target_id", "lot_multiple").agg(F.avg("value").alias("value"), F.avg("lost").alias("lost"))
    grid = rows.sparkSession.createDataFrame([(float(r),) for r in rates], "rate double")
    c = m.join(F.broadcast(grid)).withColumn("cost", F.col("value") * F.col("rate") / periods + F.col("lost"))
    best = optimum(c, ("rate", "lot_multiple"), cost="cost")
    return best.join(c.where(F.col("target_id") == base).select("rate", "lot_multiple", F.col("cost").alias("base")), ["rate", "lot_multiple"], "left").withColumn("saving", F.col("base") - F.col("cost")).drop("base")


def fold_curve(rows: DataFrame) -> DataFrame:
    """(fold, target_id, lot_multiple, total_cost): mean over models per fold."""
    f = rows.groupBy("fold", "target_id", "lot_multiple", "model").agg(F.sum("total_cost").alias("total_cost"))
    return f.groupBy("fold", "target_id", "lot_multiple").agg(F.avg("total_cost").alias("total_cost"))


def walk_forward(curve: DataFrame, base: int) -> DataFrame:
    """Per lot and fold from the second: the target that was best on average
    over all earlier folds, its cost in this fold, and the base target's."""
    w = Window.partitionBy("lot_multiple", "target_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    past = curve.withColumn("past", F.avg("total_cost").over(w)).where("past IS NOT NULL")
    pick = past.groupBy("lot_multiple", "fold").agg(F.min(F.struct("past", "target_id", "total_cost")).alias("b"))
    ref = curve.where(F.col("target_id") == base).select("lot_multiple", "fold", F.col("total_cost").alias("base_cost"))
    return pick.join(ref, ["lot_multiple", "fold"], "left").select("lot_multiple", "fold", "b.target_id", F.col("b.total_cost").alias("cost"), "base_cost")


def held_out(curve: DataFrame, base: int) -> DataFrame:
    """Leave one fold out: choose the target on the others, cost it on this one."""
    others = curve.alias("a").join(curve.alias("o"), (F.col("a.lot_multiple") == F.col("o.lot_multiple")) & (F.col("a.target_id") == F.col("o.target_id")) & (F.col("a.fold") != F.col("o.fold")))
    g = others.groupBy(F.col("a.lot_multiple").alias("lot_multiple"), F.col("a.fold").alias("fold"), F.col("a.target_id").alias("target_id")).agg(F.avg("o.total_cost").alias("past"), F.first("a.total_cost").alias("cost"))
    pick = g.groupBy("lot_multiple", "fold").agg(F.min(F.struct("past", "target_id", "cost")).alias("b"))
    ref = curve.where(F.col("target_id") == base).select("lot_multiple", "fold", F.col("total_cost").alias("base_cost"))
    return pick.join(ref, ["lot_multiple", "fold"], "left").select("lot_multiple", "fold", "b.target_id", "b.cost", "base_cost")


def dominance(curve: DataFrame, by: tuple[str, ...] = ("model",), measure: str = "csl") -> DataFrame:
    """Grid points that some other point beats on both cost and service."""
    a, b = curve.alias("a"), curve.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by]
    worse = a.join(b, [*same, F.col("b.total_cost") < F.col("a.total_cost"), F.col(f"b.{measure}") > F.col(f"a.{measure}")], "left_semi")
    return worse.groupBy(*by).agg(F.count(F.lit(1)).alias("n_dominated"))
