"""The registered queries: every operator on the driver's tables.

Doubles are rounded to six places, so that engines which add in another order
still agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mathx import Z90, cut_rank, z
from ..functions.ranks import ranks
from ..grain import WEEKLY
from ..operators import bootstrap, cleaning, decision, economics, exog, features, findings, folds, hierarchy, metrics, monitor, panel, runs, serve, simulate, sweep
from ..operators.economics import Costs
from ..operators.models import registry
from ..sources import tables
from ..sources.scratch import Scratch

LEVEL, LEAD = 0.95, WEEKLY.lead_time
COSTS = Costs()
#: Decimals of numbers under a thousand, and of larger ones, whose last digits
#: depend on the order of addition.
PLACES, LARGE_PLACES = 6, 3
#: Added to large numbers before rounding: sums of prices often end in a five.
OFF_TIES = 3e-6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at fixed places; minus zero is zero."""

    def fixed(name: str):
        x = F.col(name)
        return (F.when(F.abs(x) < 1000, F.round(x, PLACES)).otherwise(F.round(x + OFF_TIES, LARGE_PLACES)) + F.lit(0.0)).alias(name)

    return df.select(*[fixed(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def register(name: str, f: Callable[[Base], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(f(Base(spark, sf_dir)))


def query(f: Callable[[Base], DataFrame]) -> Callable[[Base], DataFrame]:
    register(f.__name__, f)
    return f


class Base:
    """Tables that queries share; each is planned once per query."""

    #: What does not depend on the lead time.
    SHARED = ("lines", "units", "end", "folds", "measures", "scales", "stats", "priced", "price_stats", "prices", "arrays", "demand")

    def __init__(self, spark: SparkSession, sf_dir: str, lead: int = LEAD):
        self.spark, self.dir, self.lead = spark, sf_dir, lead

    def at(self, lead: int) -> Base:
        """The same tables, sized for another lead time."""
        shared = {name: getattr(self, name) for name in ("prices", "arrays", "stats", "demand")}
        other = Base(self.spark, self.dir, lead)
        other.__dict__.update({name: self.__dict__[name] for name in self.SHARED if name in self.__dict__} | shared)
        return other

    @cached_property
    def lines(self) -> DataFrame:
        return tables.series_lines(self.spark, self.dir)

    @cached_property
    def dense_lines(self) -> DataFrame:
        return tables.series_lines(self.spark, self.dir, mixed=False)

    @cached_property
    def dense(self) -> DataFrame:
        return panel.build(self.dense_lines)

    @cached_property
    def units(self) -> DataFrame:
        return panel.weekly_units(self.lines)

    @cached_property
    def end(self):
        """Last week: one value for the whole plan."""
        return tables.table(self.spark, self.dir, "lineitem").agg(F.max(tables.week_of(F.col("l_shipdate")))).first()[0]

    @cached_property
    def folds(self) -> DataFrame:
        return folds.folds(self.spark, self.end, WEEKLY)

    @cached_property
    def measures(self) -> DataFrame:
        return registry.training_stats(self.arrays, folds.fold_rows(self.end, WEEKLY), WEEKLY.mase_lag, WEEKLY)

    @cached_property
    def scales(self) -> DataFrame:
        return self.measures.select("fold", "series_id", "scale_mae", "scale_mse")

    @cached_property
    def stats(self) -> DataFrame:
        return self.measures.select("fold", "series_id", "zero_rate", "volume")

    @cached_property
    def priced(self) -> DataFrame:
        """Arrays with prices, written once per query."""
        return Scratch(self.spark, "series").keep(registry.sold_arrays(self.lines, WEEKLY, True), "priced")

    @cached_property
    def price_stats(self) -> DataFrame:
        return registry.price_stats(self.priced, folds.fold_rows(self.end, WEEKLY), WEEKLY)

    @property
    def weights(self) -> DataFrame:
        return self.price_stats.select("fold", "series_id", "weight")

    @cached_property
    def prices(self) -> DataFrame:
        return registry.unit_prices(self.price_stats)

    @cached_property
    def arrays(self) -> DataFrame:
        """Written once per query: several steps read it."""
        if "priced" in self.__dict__:
            return self.priced.drop("prices")
        return Scratch(self.spark, "series").keep(registry.sold_arrays(self.lines, WEEKLY), "arrays")

    @cached_property
    def cache(self) -> DataFrame:
        return registry.quantiles(self.units, registry.LADDER, WEEKLY, self.end, self.arrays)

    @cached_property
    def forecasts(self) -> registry.Forecasts:
        return registry.Forecasts(self.arrays, registry.LADDER, WEEKLY, self.end)

    @cached_property
    def point_cache(self) -> DataFrame:
        """Point forecasts and demand over the first lead time of each fold and
        of the calibration split before the first (fold 0)."""
        first = self.folds.where("fold = 1").select(F.lit(0).alias("fold"), WEEKLY.shift(F.col("train_end"), -self.lead).alias("train_end"))
        origins = self.folds.select("fold", "train_end").unionByName(first)
        p = registry.points(self.arrays, origins, registry.LADDER, self.lead, WEEKLY)
        return p.withColumnRenamed("actual", "y")

    @cached_property
    def residuals(self) -> DataFrame:
        return decision.lead_time_residuals(self.point_cache.where("fold > 0"), self.lead)

    @cached_property
    def chained(self) -> DataFrame:
        """Residuals that size each fold: those of the fold before it."""
        past = decision.lead_time_residuals(self.point_cache.where(F.col("fold") < WEEKLY.n_folds), self.lead)
        return past.withColumn("fold", F.col("fold") + 1)

    @cached_property
    def sigma(self) -> DataFrame:
        return decision.pooled_sigma(self.chained, self.stats)

    @cached_property
    def lead_stats(self) -> DataFrame:
        return decision.lead_time_stats(self.cache, self.lead)

    @cached_property
    def lead_means(self) -> DataFrame:
        """Lead-time means alone, which need no intervals."""
        p = self.point_cache.where("fold > 0").withColumns({"p10": F.col("p50"), "p90": F.col("p50")})
        return decision.lead_time_stats(p, self.lead)

    @cached_property
    def policy(self) -> DataFrame:
        """The shipped policy: cycle service level on pooled deviations."""
        stats = self.lead_means.drop("std").join(self.sigma.withColumnRenamed("sigma", "std"), ["fold", "model", "series_id"])
        return decision.csl_policy(stats, LEVEL)

    @cached_property
    def grid(self) -> runs.Grid:
        """Runs whose tables are sums over series."""
        stats = self.price_stats  # arrays with prices serve all steps
        return runs.Grid(self.priced, stats, folds.fold_rows(self.end, WEEKLY), registry.LADDER, self.lead, WEEKLY)

    @cached_property
    def demand(self) -> DataFrame:
        return simulate.demands(self.arrays, self.folds, WEEKLY)

    @cached_property
    def detail(self) -> DataFrame:
        prices = self.prices
        return simulate.priced(simulate.detail(self.policy, self.demand, prices, self.lead, (0.0, 2.0)), COSTS, WEEKLY)

    @cached_property
    def swept(self) -> DataFrame:
        prices = self.prices
        p = sweep.policies(self.lead_means, self.sigma, sweep.targets(self.spark))
        return simulate.priced(simulate.detail(p, self.demand, prices, self.lead, (0.0, 2.0)), COSTS, WEEKLY)

    @cached_property
    def invoices(self) -> DataFrame:
        return tables.invoice_lines(self.spark, self.dir)

    @cached_property
    def log(self) -> DataFrame:
        return tables.forecast_log(self.spark, self.dir)


# ------------------------------------------------------------- panel and EDA


@query
def panel_weekly(b: Base) -> DataFrame:
    return panel.weekly_units(b.dense_lines)


@query
def panel_price_ffill(b: Base) -> DataFrame:
    return b.dense.select("series_id", "date", "price")


@query
def features_weekly(b: Base) -> DataFrame:
    return features.build(b.dense, WEEKLY)


@query
def folds_weekly(b: Base) -> DataFrame:
    return b.folds


@query
def insample_scales(b: Base) -> DataFrame:
    return b.scales


@query
def revenue_weights(b: Base) -> DataFrame:
    return b.weights


@query
def zero_rates(b: Base) -> DataFrame:
    return b.stats


@query
def unit_prices(b: Base) -> DataFrame:
    return b.prices


@query
def hashed_sample(b: Base) -> DataFrame:
    return folds.sample_hashed(b.units, 40).select("series_id").distinct()


@query
def selected_series(b: Base) -> DataFrame:
    return panel.active_series(b.units)


@query
def zero_shares(b: Base) -> DataFrame:
    return panel.zero_shares(b.units)


@query
def bulk_orders(b: Base) -> DataFrame:
    return panel.bulk_weeks(b.units, b.lines)


@query
def bulk_concentration(b: Base) -> DataFrame:
    return panel.concentration(b.units, b.lines, 45.0)


@query
def selection_effect(b: Base) -> DataFrame:
    return panel.selection_effect(b.units, 26)


@query
def closed_weeks(b: Base) -> DataFrame:
    return panel.closed_weeks(b.units)


@query
def monthly_share(b: Base) -> DataFrame:
    return panel.monthly_share(b.units)


@query
def weekday_share(b: Base) -> DataFrame:
    return panel.weekday_share(tables.shipments(b.spark, b.dir))


@query
def price_corr(b: Base) -> DataFrame:
    return panel.price_correlation(b.dense)


@query
def late_starters(b: Base) -> DataFrame:
    return panel.late_starters(b.units)


@query
def future_exog(b: Base) -> DataFrame:
    p = b.dense.withColumns({"month": F.month("date"), "weekofyear": F.weekofyear("date")})
    return exog.future(p, WEEKLY.horizon, WEEKLY)


# ------------------------------------------------------- forecasts, accuracy


def _of_model(name: str) -> Callable[[Base], DataFrame]:
    return lambda b: registry.quantiles(b.units, [name], WEEKLY, b.end, b.arrays).drop("model")


for _name, _model in (("seasonal_naive", "SeasonalNaive"), ("moving_average", "MovingAverage"), ("croston", "CrostonClassic"), ("croston_sba", "CrostonSBA"), ("tsb", "TSB")):
    register(f"forecast_{_name}", _of_model(_model))


@query
def forecast_trailing_mean(b: Base) -> DataFrame:
    return registry.served(b.units, LEAD, WEEKLY, b.arrays)


def _accuracy(b: Base) -> DataFrame:
    weights = b.weights  # arrays with prices serve all steps
    return metrics.accuracy(b.cache, b.scales, weights)


@query
def backtest_accuracy(b: Base) -> DataFrame:
    return _accuracy(b)


@query
def backtest_summary(b: Base) -> DataFrame:
    return metrics.summary(_accuracy(b))


@query
def dept_winners(b: Base) -> DataFrame:
    groups = b.units.select("series_id", F.when(F.col("series_id").contains("|"), F.substring_index("series_id", "|", -1)).otherwise(F.lit("parts")).alias("dept_id")).distinct()
    return metrics.winners(metrics.per_series(b.cache, b.scales), groups)


@query
def bucket_accuracy(b: Base) -> DataFrame:
    return metrics.by_bucket(metrics.per_series(b.cache, b.scales), b.stats)


@query
def pairwise_correlation(b: Base) -> DataFrame:
    return metrics.correlations(b.forecasts)


@query
def mean_abs_diff(b: Base) -> DataFrame:
    return metrics.mean_abs_differences(b.forecasts)


@query
def close_fractions(b: Base) -> DataFrame:
    return metrics.close_fractions(b.forecasts)


@query
def close_summary(b: Base) -> DataFrame:
    return metrics.close_summary(b.forecasts)


@query
def leadtime_blocks(b: Base) -> DataFrame:
    return metrics.lead_time_blocks(b.cache, LEAD)


@query
def leadtime_comparison(b: Base) -> DataFrame:
    return metrics.lead_time_comparison(b.forecasts, LEAD)


@query
def divergence_headline(b: Base) -> DataFrame:
    return metrics.headline(b.forecasts)


@query
def representative_series(b: Base) -> DataFrame:
    kinds = b.stats.where("fold = 1").select("series_id", metrics.bucket(F.col("zero_rate")).alias("bucket"))
    return metrics.representative(kinds, b.cache.where("model = 'MovingAverage'"))


@query
def interval_evaluation(b: Base) -> DataFrame:
    return metrics.interval_evaluation(b.cache, b.sigma, LEAD, Z90)


# ------------------------------------------------- safety stock and decisions


@query
def leadtime_residuals(b: Base) -> DataFrame:
    return b.residuals


@query
def leadtime_stats(b: Base) -> DataFrame:
    return b.lead_stats


@query
def bucket_sigma(b: Base) -> DataFrame:
    return b.sigma


def _buckets(b: Base, granularity: str) -> DataFrame:
    return decision.assign_buckets(b.stats, granularity)


@query
def volume_quintiles(b: Base) -> DataFrame:
    return _buckets(b, "volume_quintile").select("fold", "series_id", "bucket")


@query
def volume_terciles(b: Base) -> DataFrame:
    return _buckets(b, "volume_tercile_within_intermittency").select("fold", "series_id", "bucket")


@query
def safety_stock_normal(b: Base) -> DataFrame:
    return decision.bucket_safety_stock(b.residuals, _buckets(b, "intermittency"), LEVEL)


@query
def safety_stock_empirical(b: Base) -> DataFrame:
    return decision.series_safety_stock(b.residuals, _buckets(b, "volume_quintile"), LEVEL, "empirical")


@query
def within_bucket_dispersion(b: Base) -> DataFrame:
    return decision.within_bucket(decision.residual_spread(b.residuals), _buckets(b, "volume_quintile").where("fold = 1"))


@query
def buffer_diagnostics(b: Base) -> DataFrame:
    return findings.buffer_diagnostics(b.residuals, _buckets(b, "intermittency"))


@query
def reorder_decisions(b: Base) -> DataFrame:
    on_hand = F.pmod(F.length("series_id") + F.ascii("series_id") + F.col("fold"), F.lit(3)) * 0.5 * F.col("mean")
    stats = b.lead_stats.withColumn("on_hand", F.round(on_hand, PLACES))
    buffers = decision.series_safety_stock(b.residuals, _buckets(b, "intermittency"), LEVEL).drop("bucket")
    return decision.decide(stats, LEVEL, LEAD, buffers, 2.0, ("fold", "model", "series_id"), "weeks").drop("rationale")


@query
def fill_rate_policy(b: Base) -> DataFrame:
    stats = b.lead_means.drop("std").join(b.sigma.withColumnRenamed("sigma", "std"), ["fold", "model", "series_id"])
    return decision.fill_rate_policy(stats, LEVEL)


@query
def simulate_ss(b: Base) -> DataFrame:
    return b.detail.where("lot_multiple = 0").select("fold", "model", "series_id", "reorder_point", "order_up_to", "on_hand_start", *simulate.TOTALS)


@query
def simulate_order_up_to(b: Base) -> DataFrame:
    return b.detail.where("lot_multiple = 2").select("fold", "model", "series_id", "reorder_point", "order_up_to", "on_hand_start", *simulate.TOTALS, "holding_cost", "stockout_cost", "total_cost", "fill_rate")


@query
def policy_summary(b: Base) -> DataFrame:
    return simulate.pooled(b.detail)


@query
def q_stats(b: Base) -> DataFrame:
    return simulate.order_stats(b.detail)


@query
def stockout_decomposition(b: Base) -> DataFrame:
    return simulate.decomposition(b.detail)


@query
def fill_by_volume_decile(b: Base) -> DataFrame:
    placed = ranks(b.stats, ["fold"], [F.col("volume"), F.col("series_id")], "_rank", "_n")
    d = placed.select("fold", "series_id", cut_rank(F.col("_rank"), F.col("_n"), 10).alias("decile"))
    g = b.detail.join(d, ["fold", "series_id"]).groupBy("lot_multiple", "decile").agg(F.sum("shipped").alias("s"), F.sum("demanded").alias("d"))
    return g.select("lot_multiple", "decile", (F.col("s") / F.nullif("d", F.lit(0.0))).alias("fill_rate"))


# --------------------------------------------------------- economics, sweeps


@query
def reprice_grid(b: Base) -> DataFrame:
    rows = None
    for rate, margin in ((0.1, 0.2), (0.25, 0.5), (1.0, None)):
        r = economics.reprice(b.detail, Costs(rate, margin), WEEKLY).groupBy("model", "lot_multiple").agg(*[F.sum(c).alias(c) for c in ("holding_cost", "stockout_cost", "total_cost")]).withColumn("annual_rate", F.lit(rate)).withColumn("margin", F.lit(margin).cast("double"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def _parts(b: Base) -> DataFrame:
    return economics.with_rate(economics.components(b.detail), WEEKLY)


@query
def cost_components(b: Base) -> DataFrame:
    return _parts(b)


@query
def breakeven(b: Base) -> DataFrame:
    return economics.breakevens(_parts(b))


@query
def cost_curve(b: Base) -> DataFrame:
    return economics.curve(_parts(b), [0.05, 0.25, 1.0]).select("lot_multiple", "model", "rate", "cost")


@query
def critical_ratio(b: Base) -> DataFrame:
    return economics.critical_ratio(b.detail, WEEKLY, ("model", "lot_multiple"))


@query
def cycle_length(b: Base) -> DataFrame:
    return economics.cycle_length(b.detail, ("model", "lot_multiple"))


@query
def implied_ordering_cost(b: Base) -> DataFrame:
    return economics.implied_ordering_cost(b.detail, WEEKLY)


@query
def sweep_curve(b: Base) -> DataFrame:
    return sweep.curves(b.swept)


@query
def sweep_optimum(b: Base) -> DataFrame:
    return sweep.optimum(sweep.pooled(sweep.curves(b.swept)))


@query
def sweep_nominal(b: Base) -> DataFrame:
    return sweep.nominal_for(sweep.pooled(sweep.curves(b.swept)), 0.9)


@query
def sweep_flat_from(b: Base) -> DataFrame:
    return sweep.flat_from(sweep.pooled(sweep.curves(b.swept)))


@query
def choose_multiple(b: Base) -> DataFrame:
    return findings.choose_multiple(simulate.pooled(b.detail))


@query
def sweep_walk_forward(b: Base) -> DataFrame:
    return sweep.walk_forward(sweep.fold_curve(b.swept), sweep.target_id(LEVEL))


@query
def cost_ranking(b: Base) -> DataFrame:
    return findings.ranking(simulate.pooled(b.detail))


# ----------------------------------------------------------------- cleaning


@query
def clean_lines_log(b: Base) -> DataFrame:
    return cleaning.cleaning_log(b.invoices)


@query
def net_cancellations(b: Base) -> DataFrame:
    lines = b.invoices.where(cleaning.first_failed_rule().isNull())
    return cleaning.net_cancellations(lines).select("invoice", "line", "stock_code", "customer", F.col("invoice_date").cast("date").alias("day"), "quantity")


@query
def netting_stats(b: Base) -> DataFrame:
    return cleaning.netting_stats(b.invoices)


# ---------------------------------------------------------------- hierarchy

LEVELS = ("region", "nation", "type", "brand")


def _bottom(b: Base) -> DataFrame:
    s = tables.shipments(b.spark, b.dir)
    sup = tables.table(b.spark, b.dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = tables.table(b.spark, b.dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = tables.table(b.spark, b.dir, "region").select("r_regionkey", "r_name")
    geo = sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey).join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey"))
    j = s.join(geo, s.l_suppkey == geo.s_suppkey)
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "type", "brand", F.trunc("week", "year").alias("date")).agg(F.sum("units").alias("y"))


@query
def hierarchy_levels(b: Base) -> DataFrame:
    return hierarchy.totals(_bottom(b), LEVELS)


@query
def bottom_up(b: Base) -> DataFrame:
    bottom = _bottom(b)
    leaf = bottom.select(F.concat_ws(hierarchy.SEP, *LEVELS).alias("series_id"), "date", F.col("y").alias("p50"))
    return hierarchy.bottom_up(leaf, hierarchy.edges(bottom, LEVELS))


# --------------------------------------------------------------- monitoring


@query
def rolling_error(b: Base) -> DataFrame:
    e = monitor.realised_error(b.log)
    scale = b.log.groupBy("series_id").agg(F.avg("y").alias("scale"))
    return monitor.rolling_mase(e, scale, 7)


@query
def error_spikes(b: Base) -> DataFrame:
    e = monitor.realised_error(b.log)
    scale = b.log.groupBy("series_id").agg(F.avg("y").alias("scale"))
    return monitor.error_spikes(monitor.rolling_mase(e, scale, 7), 0.2)


@query
def input_drift(b: Base) -> DataFrame:
    cut = "date < date '2024-01-22'"
    return monitor.input_drift(b.log.where(cut), b.log.where(f"NOT {cut}"), 0.1)


# --------------------------------------------------- rows-only (seeded draws)


@query
def bootstrap_cost_diff(b: Base) -> DataFrame:
    d = b.detail.where("model = 'MovingAverage'").select("series_id", "fold", "lot_multiple", "total_cost")
    return bootstrap.difference(d.where("lot_multiple = 2"), d.where("lot_multiple = 0"), "total_cost")


@query
def bootstrap_fill_diff(b: Base) -> DataFrame:
    d = b.detail.where("model = 'MovingAverage'").select("series_id", "fold", "lot_multiple", "shipped", "demanded")
    return bootstrap.ratio_difference(d.where("lot_multiple = 2"), d.where("lot_multiple = 0"), "shipped", "demanded")


@query
def bootstrap_safety_stock(b: Base) -> DataFrame:
    r = b.residuals.join(_buckets(b, "intermittency").select("fold", "series_id", "bucket"), ["fold", "series_id"])
    return bootstrap.statistic(r, ["fold", "model", "bucket"], LEVEL, z=z(LEVEL))


@query
def served_reorder(b: Base) -> DataFrame:
    c = serve.fit_calibration(b.units, LEAD, LEVEL, WEEKLY)
    return serve.reorder(b.units, c, LEAD, WEEKLY)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand and type: the reorder point at 95 % and what to order now."""
    b = Base(spark, sf_dir)
    units = panel.weekly_units(b.dense_lines)
    calibration = serve.fit_calibration(units, LEAD, LEVEL, WEEKLY)
    return rounded(serve.reorder(units, calibration, LEAD, WEEKLY).select("series_id", "mean", "std", "safety_stock", "reorder_point", "on_hand", "order_up_to", "order_quantity"))
