"""Numeric column functions: the normal distribution, safe ratios, ranks, cuts."""

from __future__ import annotations

from statistics import NormalDist

from math import pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Coefficients of Hart's rational approximation of the upper normal tail
# (as given by West, "Better approximations to cumulative normal functions", 2005).
HART_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
ROOT_2PI = 2.506628274631

Z90 = NormalDist().inv_cdf(0.9)


def z(p: float) -> float:
    """Normal quantile of a number that is known when the plan is made."""
    return NormalDist().inv_cdf(p)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.lit((2 * pi) ** 0.5)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, in doubles throughout."""
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    near = e * _horner(HART_TOP, a) / _horner(HART_BOTTOM, a)
    build = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        build = a + F.lit(k) / build
    far = e / build / ROOT_2PI
    upper = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def standard_loss(k: Column) -> Column:
    """Expected shortfall of a standard normal above k."""
    return norm_pdf(k) - k * (1 - norm_cdf(k))


def loss_of(k: np.ndarray) -> np.ndarray:
    """``standard_loss`` of an array."""
    a = np.abs(k)
    e = np.exp(-a * a / 2.0)
    build = a + 0.65
    for d in (4.0, 3.0, 2.0, 1.0):
        build = a + d / build
    near = e * np.polyval(HART_TOP, a) / np.polyval(HART_BOTTOM, a)
    upper = np.where(a > 37, 0.0, np.where(a < 7.07106781186547, near, e / build / ROOT_2PI))
    return e / (2 * pi) ** 0.5 - k * np.where(k > 0, upper, 1 - upper)


def average_rank(order: WindowSpec, ties: WindowSpec) -> Column:
    """Rank where equal values share the mean of their places."""
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def cut_points(parts: int) -> list[float]:
    """Interior probabilities of equal parts, as percentages that were divided
    again: rank cuts must fall on the very doubles that pandas.qcut uses."""
    return [k * (1.0 / parts) * 100.0 / 100.0 for k in range(1, parts)]


def cut_rank(rank: Column, n: Column, parts: int) -> Column:
    """Part (from 1) of a rank among n when the ranks are cut at their linear
    quantiles. Not ntile, which cuts elsewhere for most n."""
    out = F.lit(1)
    for q in cut_points(parts):
        at = (n - 1).cast("double") * F.lit(q)
        low = F.floor(at).cast("double")
        part = at - low
        edge = F.when(part < 0.5, (low + 1) + part).otherwise((low + 2) - (1 - part))
        out = out + F.when(rank > edge, 1).otherwise(0)
    return out


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation; null where a side is flat (the built-in raises)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
