"""Forecast accuracy and how alike forecasts are.

Ratios are formed within a series, then averaged over series; missing values
are skipped, never counted as zero. How alike forecasts are is summed where they are
made, so pairs of models are never rows of a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mathx import ratio
from ..functions.ranks import counted_ranks, ranks
from ..sources.scratch import Scratch

if TYPE_CHECKING:
    from .models.registry import Forecasts

FLAT = 1e-12
CLOSE = 0.05


def pinball(y: Column, p: Column, q: float) -> Column:
    d = y - p
    return F.avg(F.greatest(q * d, (q - 1) * d))


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(y.between(low, high).cast("double"))


def weighted_average(value: Column, weight: Column) -> Column:
    """Over rows with a value; missing if their weights sum to zero."""
    w = F.when(value.isNotNull(), weight)
    return F.sum(value * w) / F.nullif(F.sum(w), F.lit(0.0))


def per_series(cache: DataFrame, scales: DataFrame) -> DataFrame:
    """(fold, model, series_id, mae, mse, mase, rmsse) from forecasts with y."""
    e = F.col("y") - F.col("p50")
    s = cache.groupBy("fold", "model", "series_id").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    return s.join(scales, ["fold", "series_id"], "left").select("fold", "model", "series_id", "mae", "mse", ratio(F.col("mae"), F.col("scale_mae")).alias("mase"), F.sqrt(ratio(F.col("mse"), F.col("scale_mse"))).alias("rmsse"))


def accuracy(cache: DataFrame, scales: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per fold and model: the backtest table."""
    s = per_series(cache, scales).join(weights, ["fold", "series_id"], "left")
    scaled = s.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n_series"), F.avg("mase").alias("mase"), F.avg("rmsse").alias("rmsse"), weighted_average(F.col("rmsse"), F.coalesce("weight", F.lit(0.0))).alias("wrmsse"))
    y, lo, mid, hi = (F.col(c) for c in ("y", "p10", "p50", "p90"))
    raw = cache.groupBy("fold", "model").agg(pinball(y, lo, 0.1).alias("pinball_p10"), pinball(y, mid, 0.5).alias("pinball_p50"), pinball(y, hi, 0.9).alias("pinball_p90"), coverage(y, lo, hi).alias("coverage_80"))
    return scaled.join(raw, ["fold", "model"])


def summary(table: DataFrame) -> DataFrame:
    """Mean over folds per model, and whether its interval misses 80 % by 0.1."""
    out = table.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("mase", "rmsse", "wrmsse", "coverage_80")])
    return out.withColumn("miscalibrated", F.abs(F.col("coverage_80") - 0.8) > 0.1)


def winners(series: DataFrame, groups: DataFrame, group: str = "dept_id") -> DataFrame:
    """(group, model, mase): the model of least mean MASE in each group; ties
    go to the first name."""
    by = series.join(groups, "series_id").groupBy(group, "model").agg(F.avg("mase").alias("mase")).where("mase IS NOT NULL")
    return by.groupBy(group).agg(F.min(F.struct("mase", "model")).alias("b")).select(group, "b.model", "b.mase")


def by_bucket(series: DataFrame, stats: DataFrame) -> DataFrame:
    """(model, bucket, n, mase, rmsse): intermittent and regular series apart."""
    b = series.join(stats, ["fold", "series_id"], "left").withColumn("bucket", bucket(F.col("zero_rate")))
    return b.groupBy("model", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("mase").alias("mase"), F.avg("rmsse").alias("rmsse"))


def bucket(zero_rate: Column, threshold: float = 0.5) -> Column:
    """A missing rate is regular."""
    return F.when(zero_rate > threshold, F.lit("intermittent")).otherwise(F.lit("regular"))


# ------------------------------------------------------------------ divergence


MOMENTS = ("n", "ma", "mb", "saa", "sbb", "sab", "diff", "n_y", "sum_y", "off_a", "off_b", "sum_r", "n_r", "n_groups")
SUMMED = ("n", "diff", "n_y", "sum_y", "off_a", "off_b", "sum_r", "n_r", "n_groups")


def _total(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """Sum in order, as rows are added up."""
    out = np.zeros(np.delete(x.shape, axis))
    for part in np.moveaxis(x, axis, 0):
        out = out + part
    return out


def _known_total(y: np.ndarray) -> np.ndarray:
    """Sum over the last axis of the values that are known; NaN without any."""
    return np.where(np.isnan(y).all(axis=-1), np.nan, _total(np.nan_to_num(y)))


def _blocks(x: np.ndarray, lead: int) -> np.ndarray:
    """The last axis cut into whole lead times, the rest left out."""
    whole = x.shape[-1] // lead
    return x[..., : whole * lead].reshape(*x.shape[:-1], whole, lead)


def _spread(x: np.ndarray, z: np.ndarray, n: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, ...]:
    """Means and sums of products of deviations over the last axis, of rows
    that are here."""
    of = np.maximum(n, 1)
    mx, mz = np.where(here, x, 0.0).sum(axis=-1) / of, np.where(here, z, 0.0).sum(axis=-1) / of
    dx, dz = np.where(here, x - mx[..., None], 0.0), np.where(here, z - mz[..., None], 0.0)
    return mx, mz, (dx * dx).sum(axis=-1), (dz * dz).sum(axis=-1), (dx * dz).sum(axis=-1)


def _moments(va: np.ndarray, vb: np.ndarray, y: np.ndarray) -> list[float]:
    """``MOMENTS`` of a pair of models over groups of rows (group, row): pooled
    moments, sums of errors, and correlations within groups. Those are missing
    where either side is flat; a group without rows is none."""
    here, known = ~np.isnan(va), ~np.isnan(va) & ~np.isnan(y)
    n = here.sum(axis=-1)
    _, _, sa, sb, sab = _spread(va, vb, n, here)
    steep = (sa > FLAT) & (sb > FLAT)
    r = sab[steep] / (np.sqrt(sa[steep]) * np.sqrt(sb[steep]))
    pooled = [float(x[0]) for x in _spread(va.reshape(1, -1), vb.reshape(1, -1), np.array([n.sum()]), here.reshape(1, -1))]
    of = lambda x, rows: float(x[rows].sum())
    return [float(n.sum()), *pooled, of(np.abs(va - vb), here), float(known.sum()), of(y, known), of(np.abs(va - y), known), of(np.abs(vb - y), known), float(r.sum()), float(len(r)), float((n > 0).sum())]


def _summed(forecasts: Forecasts, lead: int | None = None) -> DataFrame:
    """Per pair of models and kind (day: periods, grouped by fold and series;
    level: means of fold and series; lead: whole lead times, grouped by series):
    sums and sums of squares that the tables below divide. A batch of
    series gives one row per pair and kind, whatever its size."""
    names = forecasts.models
    order = [(i, j) for i in range(len(names)) for j in range(len(names)) if names[i] < names[j]]

    def reduce(p: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        steps = y.shape[-1]
        kinds = {"day": (p.reshape(len(names), -1, steps), y.reshape(-1, steps)), "level": ((_total(p) / steps).reshape(len(names), -1, 1), _known_total(y).reshape(-1, 1))}
        if lead:
            kinds["lead"] = (_total(_blocks(p, lead)).reshape(len(names), len(y), -1), _known_total(_blocks(y, lead)).reshape(len(y), -1))
        rows = [(names[i], names[j], kind, *_moments(x[i], x[j], z)) for kind, (x, z) in kinds.items() for i, j in order]
        yield pa.RecordBatch.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(("a", "b", "kind", *MOMENTS))})

    keys = ["a", "b", "kind"]
    parts = forecasts.map(reduce, "a string, b string, kind string, " + ", ".join(f"{c} double" for c in MOMENTS))
    parts = Scratch(parts.sparkSession, "pairs").keep(parts.where("n > 0"), "moments")  # read twice: one row per batch, pair and kind
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    means = parts.groupBy(*keys).agg(mean("ma").alias("mean_a"), mean("mb").alias("mean_b"))
    da, db = F.col("ma") - F.col("mean_a"), F.col("mb") - F.col("mean_b")
    between = [F.sum(F.col(s) + F.col("n") * x * z).alias(s) for s, x, z in (("saa", da, da), ("sbb", db, db), ("sab", da, db))]
    return parts.join(F.broadcast(means), keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMMED], *between)


def _pooled_corr() -> Column:
    return ratio(F.col("sab"), F.sqrt("saa") * F.sqrt("sbb"))


def _of(summed: DataFrame, kind: str, **columns: Column) -> DataFrame:
    return summed.where(F.col("kind") == kind).select("a", "b", *[c.alias(name) for name, c in columns.items()])


def _differences() -> tuple[Column, Column, Column]:
    """Mean absolute difference, demand, and mean absolute error of both."""
    return ratio(F.col("diff"), F.col("n")), ratio(F.col("sum_y"), F.col("n_y")), 0.5 * (ratio(F.col("off_a"), F.col("n_y")) + ratio(F.col("off_b"), F.col("n_y")))


def _within() -> tuple[Column, Column]:
    """Mean correlation within groups, and the share of groups that have one."""
    return ratio(F.col("sum_r"), F.col("n_r")), ratio(F.col("n_r"), F.col("n_groups"))


def _joint(forecasts: Forecasts, level: bool) -> DataFrame:
    """(m0, m1, …, n): how often all models' points (or their means over a fold
    of a series) are what they are together. Correlations of ranks need no more,
    and flat forecasts are one row for all their steps."""
    columns = [f"m{i}" for i in range(len(forecasts.models))]

    def reduce(p: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = (_total(p) / p.shape[-1] if level else p).reshape(len(columns), -1)
        x = x[:, ~np.isnan(x).any(axis=0)] + 0.0
        at = np.lexsort(x)
        x = x[:, at]
        first = np.flatnonzero(np.concatenate(([True], (x[:, 1:] != x[:, :-1]).any(axis=0)))) if x.shape[1] else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([*[pa.array(v[first]) for v in x], pa.array(np.diff(np.append(first, x.shape[1])).astype(np.int64))], [*columns, "n"])

    found = forecasts.map(reduce, ", ".join(f"{c} double" for c in columns) + ", n long")
    # values that differ by rounding alone are ties
    found = found.select(*[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in columns], "n").groupBy(*columns).agg(F.sum("n").alias("n"))
    return Scratch(found.sparkSession, "pairs").keep(found, "joint")


def _rank_correlations(forecasts: Forecasts, level: bool, name: str) -> DataFrame:
    """(a, b, name): correlation of average ranks over all rows."""
    names = forecasts.models
    rows = _joint(forecasts, level)
    points = rows.select(F.posexplode(F.array(*[f"m{i}" for i in range(len(names))])).alias("model", "value"), "n")
    table = counted_ranks(points.groupBy("model", "value").agg(F.sum("n").alias("n")), "model", "value", "n", "rank")
    for i in range(len(names)):
        rows = rows.join(table.where(F.col("model") == i).select(F.col("value").alias(f"m{i}"), F.col("rank").alias(f"r{i}")), f"m{i}")
    order = [(i, j) for i in range(len(names)) for j in range(len(names)) if names[i] < names[j]]
    ranked = Scratch(rows.sparkSession, "pairs").keep(rows.select("n", *[f"r{i}" for i in range(len(names))]), "ranked")
    # every model's mean rank is half the number of rows and one more
    off = lambda i: F.col(f"r{i}") - (F.col("_rows") + 1) / 2
    ranked = ranked.join(F.broadcast(ranked.agg(F.sum("n").alias("_rows"))))
    sums = {(i, j): F.sum(F.col("n") * off(i) * off(j)) for i in range(len(names)) for j in range(i, len(names))}
    one = ranked.agg(*[c.alias(f"s{i}_{j}") for (i, j), c in sums.items()])
    s = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}")
    found = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), ratio(s(i, j), F.sqrt(s(i, i)) * F.sqrt(s(j, j))).alias(name)) for i, j in order]
    return one.select(F.explode(F.array(*found)).alias("p")).select("p.*")


def correlations(forecasts: Forecasts) -> DataFrame:
    """Per pair of models: Pearson and Spearman pooled and between series means,
    Pearson of demeaned forecasts, and the mean of per-series correlations with
    the share of series where it is defined."""
    s = _summed(forecasts)
    within, defined = _within()
    day = _of(s, "day", pearson_pooled=_pooled_corr(), mean_series=within, defined=defined)
    out = day.join(_of(s, "level", pearson_level=_pooled_corr()), ["a", "b"])
    out = out.join(_rank_correlations(forecasts, False, "spearman_pooled"), ["a", "b"]).join(_rank_correlations(forecasts, True, "spearman_level"), ["a", "b"])
    return out.select("a", "b", "pearson_pooled", "spearman_pooled", "pearson_level", "spearman_level", "mean_series", "defined")


def mean_abs_differences(forecasts: Forecasts) -> DataFrame:
    diff, demand, mae = _differences()
    return _of(_summed(forecasts), "day", mean_abs_diff=diff, of_demand=ratio(diff, demand), of_mae=ratio(diff, mae))


def _relative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference of totals over their mean; two zeros are equal."""
    middle = (a + b) / 2
    return np.where(middle > 0, np.abs(a - b) / np.where(middle > 0, middle, 1.0), 0.0)


def _closeness(forecasts: Forecasts) -> DataFrame:
    """(a, b, n, close): series of all folds, and those whose totals differ by
    less than 5 %, summed by batch. Without a pair: those where all (a is
    'every') or any (a is 'some') are close."""
    names = forecasts.models
    order = [(i, j) for i in range(len(names)) for j in range(len(names)) if names[i] < names[j]]

    def reduce(p: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        totals = _total(p).reshape(len(names), -1)
        totals = totals[:, ~np.isnan(totals).any(axis=0)]
        close = np.array([_relative(totals[i], totals[j]) < CLOSE for i, j in order]).reshape(len(order), -1)
        rows = [(names[i], names[j], int(c.sum())) for (i, j), c in zip(order, close, strict=True)]
        rows += [("every", None, int(close.all(axis=0).sum())), ("some", None, int(close.any(axis=0).sum()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([close.shape[1]] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["a", "b", "n", "close"])

    return forecasts.map(reduce, "a string, b string, n long, close long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("close").alias("close"))


def close_fractions(forecasts: Forecasts) -> DataFrame:
    """Per pair: share of series whose totals differ by less than 5 %."""
    return _closeness(forecasts).where("b IS NOT NULL AND n > 0").select("a", "b", ratio(F.col("close"), F.col("n")).alias("close_share"))


def close_summary(forecasts: Forecasts) -> DataFrame:
    """One row: share of series where all pairs, and any pair, are close."""
    share = lambda a: F.max(F.when(F.col("a") == a, ratio(F.col("close"), F.col("n"))))
    s = _closeness(forecasts).where("b IS NULL")
    return s.agg(share("every").alias("all_close"), share("some").alias("any_close"), F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"))


def lead_time_blocks(cache: DataFrame, lead: int) -> DataFrame:
    """(model, fold, series_id, block, p50, y): totals of whole blocks."""
    b = cache.withColumn("block", F.expr(f"(step - 1) div {lead}").cast("int"))
    return b.groupBy("model", "fold", "series_id", "block").agg(F.sum("p50").alias("p50"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).where(f"n = {lead}").drop("n")


def lead_time_comparison(forecasts: Forecasts, lead: int) -> DataFrame:
    """Per pair of models: agreement per period and per lead time."""
    s = _summed(forecasts, lead)

    def side(kind: str) -> DataFrame:
        (diff, demand, mae), (within, defined) = _differences(), _within()
        found = {"pooled": _pooled_corr(), "diff": ratio(diff, demand), "of_mae": ratio(diff, mae), "within": within, "defined": defined}
        return _of(s, kind, **{f"{name}_{kind}": c for name, c in found.items()})

    return side("day").join(side("lead"), ["a", "b"])


def headline(forecasts: Forecasts, least: float = 0.95) -> DataFrame:
    """One row: number of pairs, pairs correlated above ``least``, range."""
    r = _of(_summed(forecasts), "day", pearson_pooled=_pooled_corr())
    return r.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("pearson_pooled") > least).alias("n_over"), F.min("pearson_pooled").alias("r_min"), F.max("pearson_pooled").alias("r_max")).join(F.broadcast(close_summary(forecasts)))


def representative(series: DataFrame, cache: DataFrame) -> DataFrame:
    """(bucket, series_id): the series in the middle by volume of each bucket."""
    vol = cache.where("fold = 1").groupBy("series_id").agg(F.avg("y").alias("v")).join(series, "series_id")
    ranked = ranks(vol, ["bucket"], [F.col("v"), F.col("series_id")], "r", "n")
    return ranked.where("r = floor(n / 2) + 1").select("bucket", "series_id")


# ------------------------------------------------------------------- intervals


def interval_evaluation(cache: DataFrame, sigma: DataFrame, lead: int, z80: float) -> DataFrame:
    """Native against calibrated intervals per model: coverage and width per
    period, coverage per lead time, misses on either side, and how often the
    reorder point covers demand. Calibrated half width per period is
    z sigma / sqrt(L); widths are of whole blocks only, coverage of all rows."""
    c = cache.join(sigma, ["fold", "model", "series_id"])
    half = F.lit(z80) * F.col("sigma") / F.sqrt(F.lit(float(lead)))
    c = c.withColumn("low", F.greatest(F.col("p50") - half, F.lit(0.0))).withColumn("high", F.col("p50") + half)
    c = c.withColumn("block", F.expr(f"(step - 1) div {lead}").cast("int")).withColumn("in_block", F.count(F.lit(1)).over(Window.partitionBy("fold", "model", "series_id", "block")))
    whole = F.col("in_block") == lead
    per = c.groupBy("model").agg(coverage(F.col("y"), F.col("p10"), F.col("p90")).alias("native"), coverage(F.col("y"), F.col("low"), F.col("high")).alias("calibrated"), F.avg(F.when(whole, F.col("p90") - F.col("p10"))).alias("native_width"), F.avg(F.when(whole, F.col("high") - F.col("low"))).alias("calibrated_width"))
    b = c.where(whole).groupBy("fold", "model", "series_id", "block").agg(F.sum("y").alias("y"), F.sum("p50").alias("p50"), F.first("sigma").alias("sigma"))
    off = F.col("y") - F.col("p50")
    wide = F.lit(z80) * F.col("sigma")
    lt = b.groupBy("model").agg(F.avg((F.abs(off) <= wide).cast("double")).alias("lead_time"), F.avg((off < -wide).cast("double")).alias("below"), F.avg((off > wide).cast("double")).alias("above"), F.avg((off <= F.lit(1.6448536269514722) * F.col("sigma")).cast("double")).alias("covered_by_s"))
    return per.join(lt, "model")
