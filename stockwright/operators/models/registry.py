"""Forecasts of registered models at many origins in one pass.

Every series' values are gathered once into an array; an origin is a prefix of
it. One map over Arrow batches of series forecasts every origin with every
model, and knows what was sold then, so errors, conformal intervals and actual
values need no further join: there is one shuffle by series whatever the number
of models and folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...grain import Grain
from ..folds import fold_rows
from ..panel import near_median
from .fitted import FITTED
from .native import KEPT, NATIVE

LADDER = ("SeasonalNaive", "MovingAverage", "CrostonClassic", "CrostonSBA", "TSB")
#: Global models are fitted on all series (see ``quantiles``).
GLOBAL = ("GlobalTweedie",)
#: Names that the registry knows but cannot run here.
UNAVAILABLE = {"NBEATS": "needs a GPU and a deep-learning library", "LightGBM": "needs the lightgbm library; use GlobalTweedie"}
LEVEL = 0.8
LOCAL = {**NATIVE, **FITTED}


def check(names: Iterable[str]) -> None:
    for n in names:
        if n in UNAVAILABLE:
            raise ValueError(f"{n}: {UNAVAILABLE[n]}")
        if n not in LOCAL and n not in GLOBAL:
            raise ValueError(f"no model {n!r}; have {sorted([*LOCAL, *GLOBAL])}")


def parallel(df: DataFrame) -> int:
    """Partitions for steps whose cost is computation: all cores at least."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrays(panel: DataFrame) -> DataFrame:
    """(series_id, start, ys): values in order; missing ones count as zero."""
    # an exchange that is not coalesced: what follows is work per series, not bytes
    spread = panel.select("series_id", "date", "y").repartition(parallel(panel), "series_id")
    g = spread.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("date", F.coalesce("y", F.lit(0.0)).alias("y")))).alias("a"))
    return g.select("series_id", F.col("a")[0]["date"].alias("start"), F.transform("a", lambda x: x["y"]).alias("ys"))


def sold_arrays(lines: DataFrame, grain: Grain, priced: bool = False) -> DataFrame:
    """``arrays`` of the dense panel of lines (series_id, week, units,
    unit_price), from the periods with a sale alone: empty cells are never rows.
    With ``priced`` also prices: the panel's, carried over gaps, null throughout
    where a series has none."""
    ends = lines.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))  # one row
    if priced:
        sold = near_median(lines).groupBy("series_id", "week").agg(F.sum("units").alias("y"), F.median("near").alias("p"))
    else:
        sold = lines.groupBy("series_id", "week").agg(F.sum("units").alias("y"))
    # lists of one aggregation are in one order, as none of their values is null
    lists = [F.collect_list("week").alias("weeks"), F.collect_list(F.coalesce("y", F.lit(0.0))).alias("y")]
    if priced:
        lists.append(F.collect_list(F.coalesce("p", F.lit(float("nan")))).alias("p"))
    spread = sold.repartition(parallel(sold), "series_id").groupBy("series_id").agg(*lists).join(F.broadcast(ends))
    columns = [_dense(grain, False)("weeks", "y", "lo", "hi").alias("ys")]
    if priced:
        columns.append(_dense(grain, True)("weeks", "p", "lo", "hi").alias("prices"))
    return spread.select("series_id", F.col("lo").alias("start"), *columns)


def _dense(grain: Grain, carried: bool):
    """Arrow function (weeks, values, first, last) -> values of all periods:
    zero where there is none, or the nearest known one before, else after."""
    days = grain.days

    @F.arrow_udf("array<double>")
    def fill(weeks: pa.Array, values: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        lo_, hi_ = lo.cast(pa.int32()).to_numpy(zero_copy_only=False), hi.cast(pa.int32()).to_numpy(zero_copy_only=False)
        size = (hi_ - lo_) // days + 1
        ends = np.cumsum(size)
        per = pa.compute.list_value_length(weeks).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(per)), per)
        at = (ends - size)[row] + (weeks.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False) - lo_[row]) // days
        flat = np.full(int(ends[-1]) if len(ends) else 0, np.nan if carried else 0.0)
        flat[at] = values.flatten().to_numpy(zero_copy_only=False) if carried else np.nan_to_num(values.flatten().to_numpy(zero_copy_only=False))
        if carried and len(flat):
            known, first, last = ~np.isnan(flat), np.repeat(ends - size, size), np.repeat(ends, size)
            place = np.arange(len(flat))
            before = np.maximum.accumulate(np.where(known, place, -1))
            after = np.minimum.accumulate(np.where(known, place, len(flat))[::-1])[::-1]
            flat = np.where(before >= first, flat[np.maximum(before, 0)], np.where(after < last, flat[np.minimum(after, len(flat) - 1)], np.nan))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), _doubles(flat))

    return fill


# ------------------------------------------------------------------- kernels


class _Batch:
    """The series of one Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, grain: Grain):
        self.ids, self.days = batch.column("series_id"), grain.days
        self.start = batch.column("start").cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
        ys = batch.column("ys")
        self.size = pa.compute.list_value_length(ys).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = ys.flatten().to_numpy(zero_copy_only=False)
        self.at = np.cumsum(self.size) - self.size
        self.states: dict[type, object] = {}
        self.rates: dict[tuple[type, int], np.ndarray] = {}

    def length(self, day: int) -> np.ndarray:
        """Periods of each series up to a day."""
        return np.clip((day - self.start) // self.days + 1, 0, self.size)

    def points(self, name: str, day: int, horizon: int, grain: Grain) -> np.ndarray:
        """Points by series and step from a day on; NaN without history."""
        n, out = self.length(day), np.full((len(self.size), horizon), np.nan)
        if name in NATIVE and self.columns is not None and len(n) and n.min() == n.max() > 0:
            return np.maximum(self._native(name, int(n[0]), horizon, grain), 0.0)
        for size in np.unique(n[n > 0]).tolist():
            rows = np.flatnonzero(n == size)
            out[rows] = LOCAL[name](self.flat[self.at[rows][:, None] + np.arange(size)], horizon, grain)
        return np.maximum(out, 0.0)

    @cached_property
    def columns(self) -> np.ndarray | None:
        """Values by period and series, where all series have one length."""
        if not len(self.size) or self.size.min() != self.size.max():
            return None
        return np.ascontiguousarray(self.flat.reshape(len(self.size), -1).T)

    def _native(self, name: str, n: int, horizon: int, grain: Grain) -> np.ndarray:
        """Points from the first n periods. States are kept: a later origin goes
        on from an earlier one, and models with one state share it."""
        y = self.columns[:n].T
        if name not in KEPT:
            return NATIVE[name](y, horizon, grain)
        kind, factor = KEPT[name]
        if (kind, n) not in self.rates:
            if kind not in self.states or self.states[kind].t > n:
                self.states[kind] = kind(len(y))
            self.rates[kind, n] = self.states[kind].upto(y)
        return np.repeat(np.maximum(self.rates[kind, n] * factor, 0.0)[:, None], horizon, axis=1)

    def actual(self, day: int, horizon: int) -> np.ndarray:
        """Values of the periods after a day; NaN beyond a series' last."""
        place = ((day - self.start) // self.days + 1)[:, None] + np.arange(horizon)
        known = (place >= 0) & (place < self.size[:, None])
        return np.where(known, self.flat[np.where(known, self.at[:, None] + place, 0)] if len(self.flat) else 0.0, np.nan)


def _days(day: date) -> int:
    return (day - date(1970, 1, 1)).days


def _doubles(x: np.ndarray) -> pa.Array:
    """NaN is missing."""
    return pa.array(x.ravel(), from_pandas=True)


def _long(b: _Batch, rows: np.ndarray, horizon: int, day: int, days: int, **columns) -> pa.RecordBatch:
    """One row per (series of ``rows``, step) with constants and matrices."""
    n = len(rows) * horizon
    step = np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(rows))
    out = {"series_id": b.ids.take(pa.array(np.repeat(rows, horizon))), "step": pa.array(step), "date": pa.array(day + days * step, pa.int32()).cast(pa.date32())}
    for name, x in columns.items():
        out[name] = _doubles(x[rows]) if isinstance(x, np.ndarray) else pa.array([x]).take(pa.array(np.zeros(n, np.int64))).cast(pa.int32() if isinstance(x, int) else pa.string())
    return pa.RecordBatch.from_pydict(out)


def points(arrays_: DataFrame, origins: DataFrame, models: Iterable[str], horizon: int, grain: Grain) -> DataFrame:
    """(origin columns, series_id, model, step, date, p50, actual). ``origins``
    is a small table with a column train_end and whatever identifies the origin;
    ``actual`` is the value at the forecast's date, if there is one."""
    names = list(models)
    check(names)
    if unfit := [n for n in names if n not in LOCAL]:
        raise ValueError(f"{unfit}: global models forecast through quantiles")
    wanted = origins.collect()  # one row per origin
    days = [_days(o["train_end"]) for o in wanted]

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, grain)
            for k, day in enumerate(days):
                rows, actual = np.flatnonzero(b.length(day) > 0), b.actual(day, horizon)
                for name in names:
                    out = _long(b, rows, horizon, day, grain.days, _origin=k, model=name, p50=b.points(name, day, horizon, grain), actual=actual)
                    yield out.select(["_origin", "series_id", "model", "step", "date", "p50", "actual"])

    long = arrays_.select("series_id", "start", "ys").mapInArrow(forecast, "_origin int, series_id string, model string, step int, date date, p50 double, actual double")
    key = origins.sparkSession.createDataFrame([(i, *o) for i, o in enumerate(wanted)], "_origin int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in origins.schema))
    return long.join(F.broadcast(key), "_origin").select(*origins.columns, "series_id", "model", "step", "date", "p50", "actual")


def _half_width(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0.8-quantile, linear, of two absolute errors; of one, where one is known."""
    both = np.minimum(a, b) + LEVEL * np.abs(a - b)
    return np.where(~np.isnan(both), both, np.where(~np.isnan(a), a, np.where(~np.isnan(b), b, 0.0)))


class Forecasts:
    """Points of models over the test windows of all folds, handed to a function
    of whole batches of series where they are made: what is summed there is
    never a table of rows."""

    def __init__(self, arrays_: DataFrame, models: Iterable[str], grain: Grain, end: date):
        self.arrays, self.models, self.grain = arrays_, list(models), grain
        self.folds = [(fold, _days(train_end)) for fold, train_end, _, _ in fold_rows(end, grain)]
        check(self.models)
        if unfit := [n for n in self.models if n not in LOCAL]:
            raise ValueError(f"{unfit}: global models forecast through quantiles")

    def map(self, reduce: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Rows that ``reduce`` makes of points (model, series, fold, step) and
        actual values (series, fold, step). NaN: no forecast, or not known."""
        names, folds, grain = self.models, self.folds, self.grain

        def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = _Batch(batch, grain)
                p = np.array([[b.points(name, day, grain.horizon, grain) for _, day in folds] for name in names])
                y = np.array([b.actual(day, grain.horizon) for _, day in folds])
                yield from reduce(p.transpose(0, 2, 1, 3), y.transpose(1, 0, 2))

        return self.arrays.select("series_id", "start", "ys").mapInArrow(forecast, schema)


CACHE = "fold int, model string, series_id string, step int, date date, p10 double, p50 double, p90 double, y double"


def cache(arrays_: DataFrame, models: Iterable[str], grain: Grain, end: date) -> DataFrame:
    """(fold, model, series_id, step, date, p10, p50, p90, y) of all folds.

    P10 and P90 are P50 less and plus a conformal half width per series and
    step: the 0.8-quantile of absolute errors of two earlier windows, a horizon
    and two back. All are clipped at zero.
    """
    names, horizon = list(models), grain.horizon
    folds = [(fold, _days(train_end)) for fold, train_end, _, _ in fold_rows(end, grain)]

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, grain)
            sold = {day - back * horizon * grain.days: None for _, day in folds for back in (0, 1, 2)}
            sold = {day: b.actual(day, horizon) for day in sold}
            for name in names:
                # folds share origins: each is forecast once
                found = {day: b.points(name, day, horizon, grain) for day in sold}
                off = {day: np.abs(sold[day] - p) for day, p in found.items()}
                for fold, day in folds:
                    p, rows = found[day], np.flatnonzero(b.length(day) > 0)
                    half = _half_width(*[off[day - back * horizon * grain.days] for back in (1, 2)])
                    out = _long(b, rows, horizon, day, grain.days, fold=fold, model=name, p10=np.maximum(p - half, 0.0), p50=p, p90=np.maximum(p + half, 0.0), y=sold[day])
                    yield out.select(["fold", "model", "series_id", "step", "date", "p10", "p50", "p90", "y"])

    return arrays_.select("series_id", "start", "ys").mapInArrow(forecast, CACHE)


def quantiles(panel: DataFrame, models: Iterable[str], grain: Grain, end: date, arrays_: DataFrame | None = None) -> DataFrame:
    """``cache`` of any registered models; arrays of the panel may be given."""
    names = list(models)
    check(names)
    a = arrays(panel) if arrays_ is None else arrays_
    parts = []
    if local := [n for n in names if n in LOCAL]:
        parts.append(cache(a, local, grain, end))
    if "GlobalTweedie" in names:
        from . import tweedie

        parts.append(tweedie.cache(a, grain, end))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trailing_mean(y: Column, window: int) -> Column:
    """Mean of an array's last values, not below zero."""
    k = F.least(F.size(y), F.lit(window))
    return F.greatest(F.aggregate(F.slice(y, F.size(y) - k + 1, k), F.lit(0.0), lambda a, x: a + x) / k, F.lit(0.0))


def served(panel: DataFrame, horizon: int, grain: Grain, arrays_: DataFrame | None = None) -> DataFrame:
    """(series_id, date, p10, p50, p90): the served trailing mean after each
    series' own last date; its three quantiles are equal."""
    a = arrays(panel) if arrays_ is None else arrays_
    mean = trailing_mean(F.col("ys"), grain.ma_window)
    ends = a.select("series_id", grain.shift(F.col("start"), F.size("ys") - 1).alias("end"), mean.alias("p50"))
    out = ends.select("series_id", "end", "p50", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return out.select("series_id", grain.shift(F.col("end"), F.col("step")).alias("date"), F.col("p50").alias("p10"), "p50", F.col("p50").alias("p90"))


def training_stats(arrays_: DataFrame, folds: Sequence[tuple], lag: int, grain: Grain) -> DataFrame:
    """(fold, series_id, scale_mae, scale_mse, zero_rate, volume) of every
    fold's training window; a zero scale is missing."""
    wanted = [(f[0], _days(f[1])) for f in folds]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, grain)
            for fold, day in wanted:
                n = b.length(day)
                rows = np.flatnonzero(n > 0)
                out = np.full((len(n), 4), np.nan)
                for size in np.unique(n[rows]).tolist():
                    some = np.flatnonzero(n == size)
                    y = b.flat[b.at[some][:, None] + np.arange(size)]
                    if size > lag:
                        d = y[:, lag:] - y[:, :-lag]
                        out[some, 0], out[some, 1] = np.abs(d).mean(axis=1), (d * d).mean(axis=1)
                    out[some, 2], out[some, 3] = (y == 0).mean(axis=1), y.mean(axis=1)
                out[:, :2][out[:, :2] == 0] = np.nan
                cols = [pa.array(np.full(len(rows), fold, np.int32)), b.ids.take(pa.array(rows)), *[_doubles(out[rows, c]) for c in range(4)]]
                yield pa.RecordBatch.from_arrays(cols, ["fold", "series_id", "scale_mae", "scale_mse", "zero_rate", "volume"])

    return arrays_.select("series_id", "start", "ys").mapInArrow(measure, "fold int, series_id string, scale_mae double, scale_mse double, zero_rate double, volume double")


def price_stats(arrays_: DataFrame, folds: Sequence[tuple], grain: Grain) -> DataFrame:
    """(fold, series_id, weight, n_prices, price_sum, price): revenue of the last
    horizon of training, mean training price, and what it is the mean of."""
    wanted = [(f[0], _days(f[1])) for f in folds]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, grain)
            prices = batch.column("prices").flatten().to_numpy(zero_copy_only=False)
            for fold, day in wanted:
                n = b.length(day)
                rows = np.flatnonzero(n > 0)
                out = np.full((len(n), 3), np.nan)
                for size in np.unique(n[rows]).tolist():
                    some = np.flatnonzero(n == size)
                    at = b.at[some][:, None] + np.arange(size)
                    y, p = b.flat[at], prices[at]
                    out[some, 0] = (y * np.nan_to_num(p))[:, -grain.horizon :].sum(axis=1)
                    out[some, 1], out[some, 2] = (~np.isnan(p)).sum(axis=1), np.nansum(p, axis=1)
                cols = [pa.array(np.full(len(rows), fold, np.int32)), b.ids.take(pa.array(rows)), *[_doubles(out[rows, c]) for c in range(3)]]
                yield pa.RecordBatch.from_arrays(cols, ["fold", "series_id", "weight", "n_prices", "price_sum"])

    found = arrays_.select("series_id", "start", "ys", "prices").mapInArrow(measure, "fold int, series_id string, weight double, n_prices double, price_sum double")
    return found.withColumn("price", F.col("price_sum") / F.nullif("n_prices", F.lit(0.0)))


def unit_prices(stats: DataFrame) -> DataFrame:
    """(fold, series_id, unit_price) from ``price_stats``: the mean training
    price, else the mean over all training rows of the fold."""
    every = stats.groupBy("fold").agg((F.sum("price_sum") / F.nullif(F.sum("n_prices"), F.lit(0.0))).alias("every"))
    return stats.join(F.broadcast(every), "fold").select("fold", "series_id", F.coalesce("price", "every").alias("unit_price"))
