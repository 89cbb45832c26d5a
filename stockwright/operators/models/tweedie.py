"""A global model: Tweedie regression on lag features, rolled out recursively.

One coefficient vector per fold is fitted on the training rows of all series by
Fisher scoring: each step is one pass over the series' arrays, in which tasks
send sums (a matrix and a vector as long as the list of features) and the driver
solves. Features are never stored. The rollout keeps each series' last values
as a matrix and feeds every step's forecast to the next one's lags.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ...grain import Grain
from ...sources.scratch import Scratch
from ..folds import fold_rows

POWER = 1.3
LOW, HIGH = 0.13, 0.87
STEPS, RIDGE = 12, 1e-3
#: Edges of the bins in which relative residuals are counted.
BINS = np.expm1(np.linspace(0.0, np.log1p(1e4), 8193)) - 1.0
#: Training rows that are held at once.
SOME = 1 << 18


def _features(y: np.ndarray, t: int, grain: Grain) -> np.ndarray:
    """Features of period t of some series (matrix): logs of lags and means."""
    cols = [y[:, t - k] for k in grain.lags] + [y[:, t - n : t].mean(axis=1) for n in grain.windows]
    return np.column_stack([*[np.log1p(np.maximum(c, 0.0)) for c in cols], np.ones(len(y))])


def _mean(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x @ b, -20.0, 20.0))


def _rows(b, day: int, grain: Grain) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, target) of all training rows up to a day."""
    first, n = max([*grain.lags, *grain.windows]), b.length(day)
    for size in np.unique(n[n > first]).tolist():
        rows = np.flatnonzero(n == size)
        per = max(1, SOME // size)
        for at in range(0, len(rows), per):
            some = rows[at : at + per]
            y = b.flat[b.at[some][:, None] + np.arange(size)]
            for t in range(first, size):
                yield _features(y, t, grain), y[:, t]


def _sums(arrays_: DataFrame, make, size: int) -> np.ndarray:
    """Sum over all batches of make(batch), vectors of one length."""
    from .registry import _Batch

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += make(_Batch(batch, part.grain))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    part.grain = make.grain
    found = arrays_.mapInArrow(part, "v array<double>").collect()  # one vector a task
    return np.sum([np.array(r.v) for r in found], axis=0) if found else np.zeros(size)


def fit(arrays_: DataFrame, grain: Grain, days: list[int]) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Coefficients of each origin, and the quantiles of its relative residuals."""
    k = len(grain.lags) + len(grain.windows) + 1
    beta = None

    def step(b) -> np.ndarray:
        out = []
        for i, day in enumerate(days):
            h, g, n, total = np.zeros((k, k)), np.zeros(k), 0, 0.0
            for x, y in _rows(b, day, grain):
                if beta is not None:
                    mu = _mean(x, beta[i])
                    h += (x * (mu ** (2 - POWER))[:, None]).T @ x
                    g += x.T @ ((y - mu) * mu ** (1 - POWER))
                n, total = n + len(y), total + float(y.sum())
            out.append(np.concatenate((h.ravel(), g, [n, total])))
        return np.concatenate(out)

    step.grain = grain
    for _ in range(STEPS + 1):
        sums = _sums(arrays_, step, len(days) * (k * k + k + 2)).reshape(len(days), -1)
        if beta is None:
            beta = np.zeros((len(days), k))
            beta[:, -1] = np.log(np.maximum(sums[:, -1], 1e-9) / np.maximum(sums[:, -2], 1.0))
            continue
        moved = 0.0
        for i, s in enumerate(sums):
            h, g = s[: k * k].reshape(k, k), s[k * k : k * k + k]
            ridge = RIDGE * max(1.0, s[-2])
            d = np.linalg.solve(h + ridge * np.eye(k), g - ridge * np.append(beta[i, :-1], 0.0))
            beta[i] += np.clip(d, -1.0, 1.0)
            moved = max(moved, float(np.abs(d).max()))
        if moved < 1e-6:
            break

    def residuals(b) -> np.ndarray:
        out = np.zeros((len(days), len(BINS) + 1))
        for i, day in enumerate(days):
            for x, y in _rows(b, day, grain):
                mu = _mean(x, beta[i])
                out[i] += np.bincount(np.searchsorted(BINS, (y - mu) / (1 + mu)), minlength=len(BINS) + 1)
        return out.ravel()

    residuals.grain = grain
    counts = _sums(arrays_, residuals, len(days) * (len(BINS) + 1)).reshape(len(days), -1)
    bands = []
    for c in counts:
        upto = np.cumsum(c) / max(1.0, c.sum())
        bands.append(tuple(float(BINS[min(len(BINS) - 1, int(np.searchsorted(upto, q)))]) for q in (LOW, HIGH)))
    return beta, bands


def _roll(y: np.ndarray, b: np.ndarray, horizon: int, grain: Grain) -> np.ndarray:
    """Points by series and step; each step's forecast is the next one's lag."""
    first = max([*grain.lags, *grain.windows])
    past = np.hstack([np.zeros((len(y), max(0, first - y.shape[1]))), y[:, -first:]])
    for _ in range(horizon):
        past = np.hstack([past, _mean(_features(past, past.shape[1], grain), b)[:, None]])
    return past[:, first:]


def cache(arrays_: DataFrame, grain: Grain, end: date) -> DataFrame:
    """(fold, model, series_id, step, date, p10, p50, p90, y) of all folds. P10
    and P90 are quantiles of the fold's pooled relative training residuals,
    counted in bins a thousandth wide."""
    from .registry import CACHE, _Batch, _days, _long

    held = Scratch(arrays_.sparkSession, "tweedie").keep(arrays_.select("series_id", "start", "ys"), "arrays")
    folds = [(fold, _days(train_end)) for fold, train_end, _, _ in fold_rows(end, grain)]
    beta, bands = fit(held, grain, [day for _, day in folds])

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, grain)
            for i, (fold, day) in enumerate(folds):
                n, p = b.length(day), np.full((len(b.size), grain.horizon), np.nan)
                for size in np.unique(n[n > 0]).tolist():
                    rows = np.flatnonzero(n == size)
                    p[rows] = _roll(b.flat[b.at[rows][:, None] + np.arange(size)], beta[i], grain.horizon, grain)
                low, high = (np.maximum(p + q * (1 + p), 0.0) for q in bands[i])
                out = _long(b, np.flatnonzero(n > 0), grain.horizon, day, grain.days, fold=fold, model="GlobalTweedie", p10=np.minimum(low, p), p50=p, p90=np.maximum(high, p), y=b.actual(day, grain.horizon))
                yield out.select(["fold", "model", "series_id", "step", "date", "p10", "p50", "p90", "y"])

    return held.mapInArrow(forecast, CACHE)
