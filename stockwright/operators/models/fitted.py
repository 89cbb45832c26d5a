"""Models that choose their parameters per series: exponential smoothing and theta.

Written from the published methods (Hyndman et al., 2008; Assimakopoulos and
Nikolopoulos, 2000); results need not equal any library's. All settings of all
series of a batch take a period at once with NumPy.
"""

from __future__ import annotations

from itertools import product

import numpy as np

GRID = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
#: Damping of a trend: none, and one value.
DAMP = (1.0, 0.9)
#: Series that are fitted at once, so that settings by series stay small.
SOME = 2048


def auto_ets(y: np.ndarray, horizon: int, grain) -> np.ndarray:
    """Additive-error smoothing with or without (damped) trend and season, chosen by AICc."""
    return np.vstack([_auto_ets(y[at : at + SOME], horizon, grain.model_season) for at in range(0, len(y), SOME)])


def _auto_ets(y: np.ndarray, horizon: int, season: int) -> np.ndarray:
    rows, n = y.shape
    seasons = (0.0, 0.1, 0.3) if season > 1 and n >= 2 * season else (0.0,)
    found = [(a, b, g, d) for a, b, g in product(GRID, (0.0, 0.1, 0.3), seasons) for d in (DAMP if b else (1.0,))]
    a, b, g, d = np.array(found).T
    k = 2 + 2 * (b > 0) + (d < 1) + np.where(g > 0, season, 0)
    usable = n - k - 1 > 0
    if not usable.any():
        return np.repeat(np.maximum(y.mean(axis=1), 0.0)[:, None], horizon, axis=1)
    a, b, g, d, k = (v[usable] for v in (a, b, g, d, k))
    start = y[:, : max(1, season)].mean(axis=1, keepdims=True)
    level = np.repeat(start, len(a), axis=1)
    trend = np.where(b > 0, ((y[:, -1:] - y[:, :1]) / max(1, n - 1)), 0.0)
    cycle = np.zeros((max(1, season), rows, len(a)))
    if season > 1 and n >= season:
        cycle += np.where(g > 0, (y[:, :season] - start).T[:, :, None], 0.0)
    sse = np.zeros_like(level)
    for t in range(n):
        s = cycle[t % season] if season > 1 else 0.0
        error = y[:, t : t + 1] - (level + d * trend + s)
        sse += error * error
        level = level + d * trend + a * error
        trend = d * trend + a * b * error
        if season > 1:
            cycle[t % season] = s + g * error
    aicc = n * np.log(np.maximum(sse / n, 1e-12)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    best, at = aicc.argmin(axis=1), np.arange(rows)
    out, reach, power = np.empty((rows, horizon)), np.zeros(rows), np.ones(rows)
    for h in range(horizon):
        power = power * d[best]
        reach = reach + power
        out[:, h] = level[at, best] + reach * trend[at, best] + (cycle[(n + h) % season][at, best] if season > 1 else 0.0)
    return np.maximum(out, 0.0)


def auto_theta(y: np.ndarray, horizon: int, grain) -> np.ndarray:
    """Mean of the trend line and the smoothed theta-2 line, after taking out an
    additive season where its autocorrelation is significant."""
    rows, n = y.shape
    season = grain.model_season
    if n < 3:
        return np.repeat(np.maximum(y.mean(axis=1), 0.0)[:, None], horizon, axis=1)
    index, cycle = np.arange(n), np.zeros((rows, max(1, season)))
    if season > 1 and n >= 2 * season:
        c = y - y.mean(axis=1, keepdims=True)
        r = (c[:, season:] * c[:, :-season]).sum(axis=1) / np.maximum((c * c).sum(axis=1), 1e-12)
        means = np.stack([c[:, s::season].mean(axis=1) for s in range(season)], axis=1)
        cycle = np.where((np.abs(r) > 1.645 / np.sqrt(n))[:, None], means, 0.0)
    z = y - cycle[:, index % max(1, season)]
    x = index - index.mean()
    slope = (z * x).sum(axis=1) / (x * x).sum()
    intercept = z.mean(axis=1) - slope * index.mean()
    line2 = 2 * z - (intercept[:, None] + slope[:, None] * index)
    alpha = np.array(GRID)
    level = np.repeat(line2[:, :1], len(alpha), axis=1)
    sse = np.zeros_like(level)
    for t in range(1, n):
        off = line2[:, t : t + 1] - level
        sse += off * off
        level = level + alpha * off
    steps = np.arange(n, n + horizon)
    last = level[np.arange(rows), sse.argmin(axis=1)]
    out = (intercept[:, None] + slope[:, None] * steps + last[:, None]) / 2 + cycle[:, steps % max(1, season)]
    return np.maximum(out, 0.0)


FITTED = {"AutoETS": auto_ets, "AutoTheta": auto_theta}
