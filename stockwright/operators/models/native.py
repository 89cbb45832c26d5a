"""Models that step all series of a batch at once.

A model takes the training values of some series as one matrix (series by
period, no gaps, one length) and gives their points (series by step). Work is
one NumPy operation per period, whatever the number of series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ALPHA = 0.1
SBA = 1 - ALPHA / 2

Model = Callable[..., np.ndarray]


def _flat(value: np.ndarray, horizon: int) -> np.ndarray:
    return np.repeat(np.maximum(value, 0.0)[:, None], horizon, axis=1)


def seasonal_naive(y: np.ndarray, horizon: int, grain) -> np.ndarray:
    """The last full season again; the last value where there is no season."""
    n, s = y.shape[1], grain.naive_season
    at = n - s + np.arange(horizon) % s if n >= s else np.full(horizon, n - 1)
    return np.maximum(y[:, at], 0.0)


def moving_average(y: np.ndarray, horizon: int, grain) -> np.ndarray:
    """Mean of the last window, flat; also the served trailing mean."""
    last = y[:, -grain.ma_window :]
    total = np.zeros(len(y))
    for t in range(last.shape[1]):
        total = total + last[:, t]
    return _flat(total / last.shape[1], horizon)


class Croston:
    """Smoothed size over smoothed interval of non-zero demand (Croston, 1972),
    kept so that a longer prefix goes on from a shorter one. Series without a
    sale in a period have nothing to do in it."""

    def __init__(self, n: int):
        self.size, self.gap, self.last, self.t = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n), 0

    def upto(self, y: np.ndarray) -> np.ndarray:
        for t in range(self.t, y.shape[1]):
            rows = np.flatnonzero(y[:, t] > 0)
            x, size, gap, since = y[rows, t], self.size[rows], self.gap[rows], t + 1.0 - self.last[rows]
            new = np.isnan(size)
            self.size[rows] = np.where(new, x, size + ALPHA * (x - size))
            self.gap[rows] = np.where(new, since, gap + ALPHA * (since - gap))
            self.last[rows] = t + 1.0
        self.t = y.shape[1]
        return np.where(np.isnan(self.size), 0.0, self.size / self.gap)


class Tsb:
    """Smoothed probability times smoothed size (Teunter et al., 2011), kept in
    the same way."""

    def __init__(self, n: int):
        self.p, self.size, self.t = np.zeros(n), np.full(n, np.nan), 0

    def upto(self, y: np.ndarray) -> np.ndarray:
        for t in range(self.t, y.shape[1]):
            sold = y[:, t] > 0
            self.p = sold.astype(float) if t == 0 else self.p + ALPHA * (sold - self.p)
            rows = np.flatnonzero(sold)
            x, size = y[rows, t], self.size[rows]
            self.size[rows] = np.where(np.isnan(size), x, size + ALPHA * (x - size))
        self.t = y.shape[1]
        return np.where(np.isnan(self.size), 0.0, self.p * self.size)


def croston_classic(y: np.ndarray, horizon: int, grain) -> np.ndarray:
    return _flat(Croston(len(y)).upto(y), horizon)


def croston_sba(y: np.ndarray, horizon: int, grain) -> np.ndarray:
    """Croston without its bias (Syntetos and Boylan, 2005)."""
    return _flat(Croston(len(y)).upto(y) * SBA, horizon)


def tsb(y: np.ndarray, horizon: int, grain) -> np.ndarray:
    return _flat(Tsb(len(y)).upto(y), horizon)


#: Models whose state goes on from origin to origin: state, and what its rate is
#: multiplied with.
KEPT: dict[str, tuple[type, float]] = {"CrostonClassic": (Croston, 1.0), "CrostonSBA": (Croston, SBA), "TSB": (Tsb, 1.0)}
NATIVE: dict[str, Model] = {
    "SeasonalNaive": seasonal_naive,
    "MovingAverage": moving_average,
    "CrostonClassic": croston_classic,
    "CrostonSBA": croston_sba,
    "TSB": tsb,
}
