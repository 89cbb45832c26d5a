"""Grids of policies simulated where series are forecast.

A grid has (policies by lots) times as many runs as there are forecasts, but its
tables hold sums over series. So a batch of series is forecast, labelled, sized
and simulated in one map, and gives one row of sums per cell, whatever its size.
What a series' buffer needs of all others (deviations and quantiles of residuals
by bucket, cuts of volume, the mean price) is found before and is a handful of
numbers per fold and model. ``simulate.detail`` gives the same runs as rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import z
from ..functions.ranks import counted_percentiles, ranks
from ..grain import Grain
from . import decision, simulate
from .economics import Costs
from .models.registry import LOCAL, _Batch, _days, check

KINDS = ("regular", "intermittent")
#: Volume cuts by granularity.
PARTS = {"volume_quintile": 5, "volume_tercile_within_intermittency": 3}
SUMS = ("n_series", "holding_cost", "stockout_cost", "total_cost", "_shipped", "_demanded", "cycles", "_stockouts", "_on_hand", "_factor", "_factors")
WHOLE = ("n_series", "cycles", "_stockouts", "_factors")
#: Rows that a policy can be run on at once.
ROWS = 10_000


@dataclass
class Facts:
    """What all series together say: by source the upper ends (volume,
    series_id) of volume parts, and by fold prices."""

    edges: dict[tuple[int, int], list[tuple[float, str] | None]] = field(default_factory=dict)
    price: dict[int, float] = field(default_factory=dict)
    fallback: dict[int, float] = field(default_factory=dict)


@dataclass
class Series:
    """The series of one batch."""

    batch: _Batch
    grain: Grain
    lead: int
    #: Train end by fold; 0 is the split before the first.
    days: dict[int, int]
    facts: Facts

    def __post_init__(self):
        self._measured: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def known(self, source: int) -> np.ndarray:
        """Whether a series has history."""
        return self.batch.length(self.days[source]) > 0

    def points(self, model: str, source: int, horizon: int) -> np.ndarray:
        return self.batch.points(model, self.days[source], horizon, self.grain)

    def mean(self, model: str, fold: int) -> np.ndarray:
        """Forecast demand over the lead time."""
        return _in_order(self.points(model, fold, self.lead))

    def residual(self, model: str, source: int) -> np.ndarray:
        """Realised less forecast demand over the lead time after a source."""
        return _in_order(np.nan_to_num(self.batch.actual(self.days[source], self.lead))) - self.mean(model, source)

    def block_residuals(self, model: str, fold: int) -> np.ndarray:
        """(series, block): the same over each whole lead time of a fold; NaN
        where no demand is known."""
        whole = self.grain.horizon // self.lead
        cut = lambda x: x[:, : whole * self.lead].reshape(len(x), whole, self.lead)
        y = cut(self.batch.actual(self.days[fold], self.grain.horizon))
        return np.where(np.isnan(y).all(axis=2), np.nan, _in_order(np.nan_to_num(y))) - _in_order(cut(self.points(model, fold, self.grain.horizon)))

    def measured(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """Zero rate and volume of the training window; NaN without history."""
        if source not in self._measured:
            n = self.batch.length(self.days[source])
            zero, volume = np.full(len(n), np.nan), np.full(len(n), np.nan)
            for size in np.unique(n[n > 0]).tolist():
                some = np.flatnonzero(n == size)
                y = self.batch.flat[self.batch.at[some][:, None] + np.arange(size)]
                zero[some], volume[some] = (y == 0).mean(axis=1), y.mean(axis=1)
            self._measured[source] = zero, volume
        return self._measured[source]

    def kind(self, source: int) -> np.ndarray:
        """Place in ``KINDS``."""
        return (self.measured(source)[0] > 0.5).astype(np.int64)

    def part(self, source: int, parts: int) -> np.ndarray:
        """Part of the volume among all series, from 0."""
        volume = self.measured(source)[1]
        out = np.zeros(len(volume), np.int64)
        for edge in self.facts.edges[source, parts]:
            if edge is None:
                out += 1
                continue
            over = volume > edge[0]
            tied = np.flatnonzero(volume == edge[0])
            over[tied] = pa.compute.greater(self.batch.ids.take(pa.array(tied)), edge[1]).to_numpy(zero_copy_only=False)
            out += over
        return out

    def demand(self, fold: int) -> np.ndarray:
        return self.batch.actual(self.days[fold], self.grain.horizon)

    def price(self, prices: pa.Array, fold: int) -> np.ndarray:
        """Mean training price, else that of all training rows, else the mean
        over series."""
        n, flat = self.batch.length(self.days[fold]), prices.flatten().to_numpy(zero_copy_only=False)
        out = np.full(len(n), np.nan)
        for size in np.unique(n[n > 0]).tolist():
            some = np.flatnonzero(n == size)
            p = flat[self.batch.at[some][:, None] + np.arange(size)]
            count = (~np.isnan(p)).sum(axis=1)
            out[some] = np.where(count > 0, np.nansum(p, axis=1) / np.maximum(count, 1), np.nan)
        out = np.where(np.isnan(out), self.facts.price.get(fold, np.nan), out)
        return np.where(np.isnan(out), self.facts.fallback.get(fold, np.nan), out)


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sum over the last axis, as rows are added up."""
    out = np.zeros(x.shape[:-1])
    for t in range(x.shape[-1]):
        out = out + x[..., t]
    return out


def chained(s: Series, folds: Sequence[int], models: Sequence[str], labels: Callable[[int], dict[tuple, np.ndarray]]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Residuals that size each fold, those after the source before it, under
    every labelling (name: labels) of the fold."""
    for fold in folds:
        known = s.known(fold - 1)
        named = {name: np.where(known, label, 0) for name, label in labels(fold).items()}
        for model in models:
            x = s.residual(model, fold - 1)
            for name, label in named.items():
                yield (*name, fold, model), label, x


Sized = Callable[[Series, int, str, np.ndarray, np.ndarray], Iterable[np.ndarray]]


class Grid:
    """Policies over the folds of all series (series_id, start, ys, prices)."""

    def __init__(self, arrays_: DataFrame, price_stats: DataFrame, fold_rows: Sequence[tuple], models: Iterable[str], lead: int, grain: Grain):
        self.arrays, self.price_stats, self.models, self.lead, self.grain = arrays_, price_stats, list(models), lead, grain
        check(self.models)
        if unfit := [n for n in self.models if n not in LOCAL]:
            raise ValueError(f"{unfit}: global models forecast through quantiles")
        self.folds = [f[0] for f in fold_rows]
        self.days = {f[0]: _days(f[1]) for f in fold_rows} | {0: _days(grain.before(fold_rows[0][1], lead))}
        self.facts = Facts()

    def _map(self, f: Callable[[Series, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, *columns: str) -> DataFrame:
        grain, lead, days, facts = self.grain, self.lead, self.days, self.facts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from f(Series(_Batch(batch, grain), grain, lead, days, facts), batch)

        return self.arrays.select("series_id", "start", "ys", *columns).mapInArrow(run, schema)

    # ------------------------------------------------- what all series say

    def cut_volume(self, sources: Sequence[int], *parts: int) -> None:
        """Find the parts of volume; ties are by series_id."""

        def measure(s: Series, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for source in sources:
                rows = np.flatnonzero(s.known(source))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), source, np.int32)), s.batch.ids.take(pa.array(rows)), pa.array(s.measured(source)[1][rows])], ["source", "series_id", "volume"])

        placed = ranks(self._map(measure, "source int, series_id string, volume double"), ["source"], [F.col("volume"), F.col("series_id")], "_rank", "_n")
        for n in parts:
            top = placed.groupBy("source", decision.volume_part(F.col("_rank"), F.col("_n"), n).alias("part")).agg(F.max(F.struct("volume", "series_id")).alias("top"))
            found = {(r["source"], r["part"]): tuple(r["top"]) for r in top.collect()}  # a row per source and part
            for source in sources:
                lower = [[found[source, k] for k in range(1, upto + 1) if (source, k) in found] for upto in range(1, n)]
                self.facts.edges[source, n] = [max(x, key=lambda e: (e[0], e[1].encode())) if x else None for x in lower]

    @cached_property
    def _priced(self) -> None:
        """Mean prices by fold: those of ``registry.unit_prices``, and their mean."""
        s = self.price_stats.groupBy("fold").agg(F.sum("price_sum").alias("total"), F.sum("n_prices").alias("n"), F.sum("price").alias("own"), F.count("price").alias("n_own"), F.count(F.lit(1)).alias("n_all"))
        for r in s.collect():  # a row per fold
            if r["n"]:
                self.facts.price[r["fold"]] = every = r["total"] / r["n"]
                self.facts.fallback[r["fold"]] = ((r["own"] or 0.0) + (r["n_all"] - r["n_own"]) * every) / r["n_all"]

    def spreads(self, observe: Callable[[Series], Iterator[tuple[tuple, np.ndarray, np.ndarray]]]) -> Spreads:
        """Sample deviations of what ``observe`` yields: key, label of each row
        (a small whole number) and residuals (NaN: none)."""

        def moments(s: Series, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for key, label, x in observe(s):
                here = ~np.isnan(x)
                label, x = label[here], x[here]
                n = np.bincount(label)
                mean = np.bincount(label, x) / np.maximum(n, 1)
                square = np.bincount(label, (x - mean[label]) ** 2)
                rows += [("|".join(map(str, key)), int(k), float(n[k]), float(mean[k]), float(square[k])) for k in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["key", "label", "n", "mean", "square"])

        parts = self._map(moments, "key string, label long, n double, mean double, square double")
        g = parts.groupBy("key", "label").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("square").alias("square"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("far"))
        found = g.select("key", "label", "n", "mean", (F.col("square") + F.greatest(F.col("far") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))).alias("square"))
        return Spreads({(*r["key"].split("|"), r["label"]): (r["n"], r["mean"], r["square"]) for r in found.collect()})  # a row per bucket

    def quantiles(self, observe: Callable[[Series], Iterator[tuple[tuple, np.ndarray, np.ndarray]]], level: float) -> dict[tuple, float]:
        """Exact quantiles by linear interpolation, by key and label."""

        def counts(s: Series, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for key, label, x in observe(s):
                here = ~np.isnan(x)
                label, x = label[here], x[here] + 0.0
                at = np.lexsort((x, label))
                label, x = label[at], x[at]
                first = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (x[1:] != x[:-1])))) if len(x) else np.zeros(0, int)
                name = "|".join(map(str, key))
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}|{k}" for k in label[first].tolist()], pa.string()), pa.array(x[first]), pa.array(np.diff(np.append(first, len(x))).astype(np.int64))], ["key", "value", "n"])

        found = self._map(counts, "key string, value double, n long").groupBy("key", "value").agg(F.sum("n").alias("n"))
        return {tuple(r["key"].split("|")): r["q"] for r in counted_percentiles(found, "key", "value", "n", {"q": level}).collect()}  # a row per bucket

    @cached_property
    def sigma(self) -> Spreads:
        """Deviations by fold, model and place in ``KINDS``."""
        folds, models = self.folds, self.models
        return self.spreads(lambda s: chained(s, folds, models, lambda fold: {(): s.kind(fold)}))

    # ------------------------------------------------------------------- runs

    def run(self, cells: Sequence[dict], sized: Sized, lots: Sequence[float], costs: Costs, start_fraction: float = 0.5) -> DataFrame:
        """(cell columns, lot_multiple, fold, model, ``SUMS``): sums over series
        of every cell's policy. ``sized`` yields a cell's safety stocks, in order,
        given a fold, a model, lead-time means and pooled deviations."""
        self._priced  # noqa: B018
        sigma, folds, models, lead, grain = self.sigma, self.folds, self.models, self.lead, self.grain
        rate, margin, flat = grain.period_rate(costs.holding_rate), costs.margin, costs.flat_penalty
        columns = ["cell", "lot_multiple", "fold", "model", *SUMS]

        def simulate_batch(s: Series, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for fold in folds:
                demand, price = s.demand(fold), s.price(batch.column("prices"), fold)
                periods = (~np.isnan(demand)).sum(axis=1)
                here = s.known(fold - 1) & (periods > 0)
                kind = s.kind(fold)
                unit_cost, penalty = (price, np.full(len(price), flat)) if margin is None else (price * (1 - margin), price * margin)
                for model in models:
                    mean, std = s.mean(model, fold), sigma.of((fold, model), kind, KINDS)
                    for cell, buffer in enumerate(sized(s, fold, model, mean, std)):
                        buffer = np.broadcast_to(buffer, mean.shape)
                        some = np.flatnonzero(here & ~np.isnan(mean + buffer))
                        if len(some):
                            factor = buffer[some][std[some] != 0] / std[some][std[some] != 0]
                            factor = factor[~np.isnan(factor)]
                            for lot in lots:
                                t = _totals(demand[some], periods[some], mean[some], (mean + buffer)[some], lot, start_fraction, lead)
                                held, lost = rate * unit_cost[some] * t["stocked"], penalty[some] * t["lost"]
                                sums = (len(some), _sum(held), _sum(lost), _sum(held + lost), t["shipped"].sum(), t["demanded"].sum(), t["cycles"].sum(), t["stockouts"].sum(), (t["stocked"] / periods[some]).sum(), factor.sum(), len(factor))
                                rows.append((cell, lot, fold, model, *[int(x) if c in WHOLE else x for c, x in zip(SUMS, sums, strict=True)]))
            kinds = [pa.int32(), pa.float64(), pa.int32(), pa.string(), *[pa.int64() if c in WHOLE else pa.float64() for c in SUMS]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], columns)

        schema = "cell int, lot_multiple double, fold int, model string, " + ", ".join(f"{c} {'long' if c in WHOLE else 'double'}" for c in SUMS)
        parts = self._map(simulate_batch, schema, "prices")
        g = parts.groupBy("cell", "lot_multiple", "fold", "model").agg(*[F.sum(c).alias(c) for c in SUMS])
        spark = self.arrays.sparkSession
        names = list(cells[0])
        types = {str: "string", int: "long", float: "double"}
        key = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(cells)], "cell int, " + ", ".join(f"`{n}` {types[type(cells[0][n])]}" for n in names))
        return g.join(F.broadcast(key), "cell").select(*names, "lot_multiple", "fold", "model", *SUMS)


def _sum(x: np.ndarray) -> float | None:
    """Sum of what is known; missing where nothing is."""
    return None if np.isnan(x).all() else float(np.nansum(x))


def _totals(demand: np.ndarray, periods: np.ndarray, mean: np.ndarray, point: np.ndarray, lot: float, start_fraction: float, lead: int) -> dict[str, np.ndarray]:
    """``simulate.steps`` of rows whose windows may end early."""
    more = lot * np.maximum(mean, 0.0)
    args = [np.round(x, simulate.PLACES) for x in (point, point + more, point + start_fraction * more)]
    wanted = ("cycles", "stockouts", "shipped", "demanded", "lost", "stocked")
    out = {c: np.zeros(len(mean)) for c in wanted}
    for n in np.unique(periods).tolist():
        rows = np.flatnonzero(periods == n)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            for c, x in simulate.steps(demand[some, :n], *[a[some] for a in args], lead, wanted).items():
                out[c][some] = x
    return out


@dataclass
class Spreads:
    """(n, mean, sum of squared deviations) by key and label."""

    rows: dict[tuple, tuple[float, float, float]]

    def __post_init__(self):
        self.by: dict[tuple, dict[int, tuple]] = defaultdict(dict)
        for k, v in self.rows.items():
            self.by[k[:-1]][int(k[-1])] = v

    def deviation(self, key: tuple, labels: Iterable[int] | None = None) -> float:
        """Sample deviation of all rows with these labels (None: all); NaN of
        fewer than two."""
        found = self.by.get(tuple(map(str, key)), {})
        some = [v for k, v in found.items() if labels is None or k in labels]
        n = sum(v[0] for v in some)
        if n < 2:
            return float("nan")
        mean = sum(v[0] * v[1] for v in some) / n
        return (sum(v[2] + v[0] * (v[1] - mean) ** 2 for v in some) / (n - 1)) ** 0.5

    def of(self, key: tuple, bucket: np.ndarray, names: Sequence) -> np.ndarray:
        """Deviation of each row's bucket, else of all rows."""
        every = self.deviation(key)
        own = [self.deviation(key, (k,)) for k in range(len(names))]
        return np.array([every if np.isnan(x) else x for x in own])[bucket]


# ---------------------------------------------------------------- the grids


def swept(grid: Grid, targets: Sequence[tuple[int, float]], lots: Sequence[float], costs: Costs) -> DataFrame:
    """Cycle service levels (target_id, z)."""

    def sized(s: Series, fold: int, model: str, mean: np.ndarray, std: np.ndarray) -> Iterator[np.ndarray]:
        for _, factor in targets:
            yield factor * std

    return grid.run([{"target_id": i} for i, _ in targets], sized, lots, costs)


def schemes(grid: Grid, pairs: Sequence[tuple[str, str]], target: float, lots: Sequence[float], costs: Costs) -> DataFrame:
    """Buffers by (form, granularity): ``grids.scheme_policies``."""
    grid.cut_volume(grid.folds, *{PARTS[g] for _, g in pairs if g in PARTS})
    buckets = {
        "intermittency": lambda s, fold: s.kind(fold),
        "volume_quintile": lambda s, fold: s.part(fold, 5),
        "volume_tercile_within_intermittency": lambda s, fold: 3 * s.kind(fold) + s.part(fold, 3),
    }
    n_buckets = {"intermittency": 2, "volume_quintile": 5, "volume_tercile_within_intermittency": 6}
    folds, models = grid.folds, grid.models
    of = {f: sorted({g for form, g in pairs if form == f}) for f in decision.FORMS}

    def observe(form: str) -> Callable[[Series], Iterator[tuple[tuple, np.ndarray, np.ndarray]]]:
        whole = {("every",): lambda s, fold: np.zeros(len(s.batch.size), np.int64)} if form == "empirical" else {}
        labels = {(g,): buckets[g] for g in of[form]} | whole
        return lambda s: chained(s, folds, models, lambda fold: {name: label(s, fold) for name, label in labels.items()})

    normal = grid.spreads(observe("normal")) if of["normal"] else None
    empirical = grid.quantiles(observe("empirical"), target) if of["empirical"] else {}
    factor = z(target)

    def sized(s: Series, fold: int, model: str, mean: np.ndarray, std: np.ndarray) -> Iterator[np.ndarray]:
        for form, g in pairs:
            bucket = buckets[g](s, fold)
            if form == "normal":
                yield factor * normal.of((g, fold, model), bucket, range(n_buckets[g]))
            else:
                whole = empirical.get(("every", str(fold), model, "0"), np.nan)
                yield np.array([empirical.get((g, str(fold), model, str(k)), whole) for k in range(n_buckets[g])])[bucket]

    return grid.run([{"form": f, "granularity": g} for f, g in pairs], sized, lots, costs)


def windows(grid: Grid, names: Sequence[str], poolings: Sequence[str], target: float, lots: Sequence[float], costs: Costs) -> DataFrame:
    """Buffers by (window, pooling): ``grids.windows`` and ``grids.window_policies``."""
    sources = [f - 1 for f in grid.folds]
    grid.cut_volume(sources, 5)
    buckets = {"intermittency": lambda s, source: s.kind(source), "volume_quintile": lambda s, source: s.part(source, 5)}
    n_buckets = {"intermittency": 2, "volume_quintile": 5}
    first, models = grid.folds[0], grid.models

    def observe(s: Series) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """By source: what follows its train end, over the first lead time and,
        after the split, over every one of the fold."""
        for source in sources:
            known = s.known(source)
            labels = {p: np.where(known, buckets[p](s, source), 0) for p in poolings}
            for model in models:
                x = s.residual(model, source)
                more = np.where(known[:, None], s.block_residuals(model, source), np.nan) if source >= first else None
                for pooling, label in labels.items():
                    yield (pooling, "lead", source, model), label, x
                    if more is not None:
                        yield (pooling, "blocks", source, model), np.repeat(label, more.shape[1]), more.ravel()

    found = grid.spreads(observe)

    def seen(window: str, fold: int) -> tuple[str, int, int]:
        """Kind and source of residuals, and the source of labels."""
        if window == "single":
            return "lead", first - 1, first - 1
        if window == "first_window" or fold == first:
            return "lead", fold - 1, fold - 1
        return "blocks", fold - 1, fold - 1

    factor = z(target)

    def sized(s: Series, fold: int, model: str, mean: np.ndarray, std: np.ndarray) -> Iterator[np.ndarray]:
        for window in names:
            what, source, label = seen(window, fold)
            for pooling in poolings:
                buffer = factor * found.of((pooling, what, source, model), buckets[pooling](s, label), range(n_buckets[pooling]))
                yield np.where(s.known(label), buffer, np.nan)

    return grid.run([{"window": w, "pooling": p} for w in names for p in poolings], sized, lots, costs)


def targets_met(grid: Grid, policies: Sequence[str], target: float, lots: Sequence[float], costs: Costs) -> DataFrame:
    """The policies of ``decision.POLICIES`` at one target."""
    by = {"csl": lambda mean, std: z(target) * std, "fill_rate": lambda mean, std: decision.fill_rate_factors(target, mean, std) * std}

    def sized(s: Series, fold: int, model: str, mean: np.ndarray, std: np.ndarray) -> Iterator[np.ndarray]:
        for name in policies:
            yield by[name](mean, std)

    return grid.run([{"policy": p} for p in policies], sized, lots, costs)
