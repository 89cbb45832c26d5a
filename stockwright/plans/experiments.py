"""Registered queries on grids of policies, rules on their curves, and checks
of runs against runs. Importing this adds them to the others."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import Z90, z
from ..grain import WEEKLY
from ..operators import audit, bootstrap, cleaning, decision, economics, findings, grids, metrics, runs, simulate, sweep
from ..operators.models import registry
from ..sources.scratch import Scratch
from .queries import COSTS, LEAD, LEVEL, Base, _accuracy, query

LOTS = (0.0, 2.0)
RATES = (0.05, 0.1, 0.25, 0.5, 1.0)
#: The ladder without its seasonal benchmark.
CLUSTER = [m for m in registry.LADDER if m != "SeasonalNaive"]
CHECKED = ("reorder_point", "order_up_to", "orders", "shipped", "lost", "stocked", "total_cost")


def _run(b: Base, policies: DataFrame, lots: tuple[float, ...] = LOTS) -> DataFrame:
    return simulate.priced(simulate.detail(policies, b.demand, b.prices, b.lead, lots), COSTS, WEEKLY)


# ------------------------------------------------------------ rules on curves


@query
def sweep_optimal_by_rate(b: Base) -> DataFrame:
    return sweep.optimal_by_rate(b.swept, list(RATES), sweep.target_id(LEVEL), WEEKLY.periods_per_year)


@query
def sweep_held_out(b: Base) -> DataFrame:
    curve = Scratch(b.spark, "sweep").keep(sweep.fold_curve(b.swept), "fold_curve")  # read twice
    return sweep.held_out(curve, sweep.target_id(LEVEL))


@query
def sweep_nearest(b: Base) -> DataFrame:
    return sweep.nearest(sweep.pooled(sweep.curves(b.swept)), "csl", 0.9)


@query
def sweep_dominance(b: Base) -> DataFrame:
    sums = runs.swept(b.grid, [(sweep.target_id(t), z(t)) for t in sweep.TARGETS], LOTS, COSTS)
    named = {f"_{c}": c for c in ("stockouts", "shipped", "demanded")}
    curve = Scratch(b.spark, "sweep").keep(sweep.curve_of(sums.withColumnsRenamed(named)), "curves")
    return sweep.dominance(curve, ("model", "lot_multiple"))


@query
def rank_agreement(b: Base) -> DataFrame:
    accuracy = _accuracy(b)
    return findings.rank_agreement(accuracy, simulate.pooled(b.detail.where("lot_multiple = 2")))


@query
def bucket_cost_table(b: Base) -> DataFrame:
    kinds = b.stats.select("fold", "series_id", metrics.bucket(F.col("zero_rate")).alias("bucket"))
    return grids.cell_summary(b.detail.join(kinds, ["fold", "series_id"]), ("bucket", "lot_multiple"))


# --------------------------------------------------------------------- grids


@query
def scheme_grid(b: Base) -> DataFrame:
    sums = runs.schemes(b.grid, grids.SCHEMES, LEVEL, LOTS, COSTS)
    return simulate.pooled_sums(sums, ("form", "granularity", "fold", "model", "lot_multiple"))


@query
def policy_grid(b: Base) -> DataFrame:
    """Margins, lead times and lots."""
    rows = None
    for lead in grids.LEADS:
        r = b.at(lead).detail.withColumn("lead", F.lit(lead))
        rows = r if rows is None else rows.unionByName(r)
    return grids.cell_summary(grids.margin_rows(rows, COSTS.holding_rate, WEEKLY), ("margin", "lead", "lot_multiple"))


@query
def posthoc_buffers(b: Base) -> DataFrame:
    """Windows and poolings of residuals, at the shipped lot."""
    return simulate.pooled_sums(runs.windows(b.grid, grids.WINDOWS, grids.POOLINGS, LEVEL, (2.0,), COSTS), ("window", "pooling", "fold", "model"))


@query
def fill_rate_simulated(b: Base) -> DataFrame:
    """Both registered policies at the same target."""
    return simulate.pooled_sums(runs.targets_met(b.grid, list(decision.POLICIES), LEVEL, LOTS, COSTS), ("policy", "fold", "model", "lot_multiple"))


# ------------------------------------------------------------------ findings


@query
def finding_coverage(b: Base) -> DataFrame:
    detail = b.detail.where("lot_multiple = 2").where(F.col("model").isin(CLUSTER))
    intervals = metrics.interval_evaluation(b.cache.where(F.col("model").isin(CLUSTER)), b.sigma, LEAD, Z90)
    return findings.coverage_finding(intervals, simulate.decomposition(detail), LEVEL)


def _stored(b: Base) -> DataFrame:
    return Scratch(b.spark, "detail").keep(b.detail.select(*grids.KEYS, "lot_multiple", "total_cost"), "costs")


def _differences(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(model, point, ci_lo, ci_hi, …) of paired bootstraps of cost."""
    rows = None
    for name, x, y in pairs:
        r = bootstrap.difference(x, y, "total_cost").withColumn("model", F.lit(name))
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query
def finding_policy_over_model(b: Base) -> DataFrame:
    d = _stored(b)
    of = lambda m, lot: d.where((F.col("model") == m) & (F.col("lot_multiple") == lot)).drop("model")
    cost = d.where("lot_multiple = 2").groupBy("model", "fold").agg(F.sum("total_cost").alias("c")).groupBy("model").agg(F.avg("c").alias("cost"))
    return findings.policy_over_model(_differences([(m, of(m, 2.0), of(m, 0.0)) for m in registry.LADDER]), cost, CLUSTER)


@query
def finding_cluster_tie(b: Base) -> DataFrame:
    d = _stored(b).where("lot_multiple = 2")
    of = lambda m: d.where(F.col("model") == m).drop("model")
    return findings.ties(_differences([(f"{x} - {y}", of(x), of(y)) for x, y in combinations(CLUSTER, 2)]))


# -------------------------------------------------------------------- audits


@query
def quantile_independence(b: Base) -> DataFrame:
    """Decisions of the shipped policy with true and with constant P10 and P90."""

    def run(cache: DataFrame) -> DataFrame:
        stats = decision.lead_time_stats(cache, LEAD).drop("std").join(b.sigma.withColumnRenamed("sigma", "std"), grids.KEYS)
        return Scratch(b.spark, "audit").keep(_run(b, decision.csl_policy(stats, LEVEL), (2.0,)).select(*grids.KEYS, *CHECKED), "run")

    return audit.changes(run(b.cache), run(audit.scrambled(b.cache)), grids.KEYS, CHECKED)


@query
def stored_run_check(b: Base) -> DataFrame:
    """Rows of a stored run against those of another run from the start."""
    keys = [*grids.KEYS, "lot_multiple"]
    stored = Scratch(b.spark, "audit").keep(b.detail.select(*keys), "stored")
    return audit.row_sets(stored, Base(b.spark, b.dir).detail, keys)


@query
def repriced_run_check(b: Base) -> DataFrame:
    """Costs of a run priced at another rate and margin against its re-pricing."""
    other = economics.Costs(0.5, 0.4)
    run = Scratch(b.spark, "audit").keep(b.detail, "detail")
    keys, amounts = [*grids.KEYS, "lot_multiple"], ["holding_cost", "stockout_cost", "total_cost"]
    direct = simulate.priced(run.drop(*amounts, "fill_rate", "avg_on_hand"), other, WEEKLY)
    c = audit.changes(economics.reprice(run, other, WEEKLY), direct, keys, amounts)
    return c.select("column", "n_rows", "n_one_sided", (F.col("max_change") < 1e-3).alias("same"))


# ------------------------------------------------------------------ cleaning


@query
def clean_weekly(b: Base) -> DataFrame:
    """All cleaning rules, then weekly net sales by product of whole weeks."""
    ends = b.invoices.agg(F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi")).first()
    if ends["lo"] is None:
        lines = cleaning.clean_lines(b.invoices)
    else:
        first, last = cleaning.whole_weeks(ends["lo"].date(), ends["hi"].date())
        lines = cleaning.clean_lines(b.invoices, first, last)
    return lines.groupBy("stock_code", "week").agg(F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("n_lines"))
