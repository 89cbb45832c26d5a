"""How alike forecasts are: against loops over all rows, and no table of pairs."""

from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwright.functions.ranks import counted_ranks
from stockwright.grain import WEEKLY
from stockwright.operators import metrics
from stockwright.operators.models import registry

END = date(2024, 12, 30)
MODELS = ("SeasonalNaive", "MovingAverage", "TSB")


@pytest.fixture(scope="module")
def forecasts(spark):
    """Series of several lengths: one begins after two folds, one ends in the last fold's window."""
    rng, rows = np.random.default_rng(4), []
    for i, (size, left) in enumerate([(120, 0), (120, 0), (20, 0), (90, 0), (120, 5), (120, 0)]):
        ys = np.where(rng.random(size) < 0.4, 0.0, rng.integers(1, 9, size)).astype(float)
        rows.append((f"s{i}", END - timedelta(days=7 * (size - 1 + left)), (ys * (i != 5)).tolist()))
    arrays = spark.createDataFrame(rows, "series_id string, start date, ys array<double>").repartition(3)
    return registry.Forecasts(arrays, MODELS, WEEKLY, END), registry.cache(arrays, MODELS, WEEKLY, END).collect()


def _corr(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    both = np.sqrt(((x - x.mean()) ** 2).sum() * ((y - y.mean()) ** 2).sum())
    return ((x - x.mean()) * (y - y.mean())).sum() / both if both else None


def _ranks(x):
    x = np.round(x, 9)
    return [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]


def _groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def _within(pairs, key):
    r = []
    for g in _groups(pairs, key).values():
        x, z = np.array([p[1] for p in g]), np.array([p[2] for p in g])
        flat = min(((x - x.mean()) ** 2).sum(), ((z - z.mean()) ** 2).sum()) <= metrics.FLAT
        r.append(None if flat else _corr(x, z))
    some = [x for x in r if x is not None]
    return (np.mean(some) if some else None), len(some) / len(r)


def _pairs(cache, a, b, key):
    """(key, value of a, value of b, y) of both models' rows."""
    left = {key(r): r for r in cache if r["model"] == a}
    return [(k, left[k]["p50"], r["p50"], r["y"]) for r in cache if r["model"] == b for k in [key(r)] if k in left]


def _errors(pairs):
    y = np.array([np.nan if p[3] is None else p[3] for p in pairs], float)
    x, z = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
    diff = np.abs(x - z).mean()
    return diff, diff / np.nanmean(y), diff / (0.5 * (np.nanmean(np.abs(x - y)) + np.nanmean(np.abs(z - y))))


def test_measures_equal_loops_over_all_rows(forecasts):
    made, cache = forecasts
    same = lambda got, want: all(g is None and w is None or g == pytest.approx(w, abs=1e-9) for g, w in zip(got, want, strict=True))
    by = lambda df: {(r.a, r.b): tuple(r)[2:] for r in df.collect()}
    corr, diff, lead, close = by(metrics.correlations(made)), by(metrics.mean_abs_differences(made)), by(metrics.lead_time_comparison(made, 2)), by(metrics.close_fractions(made))
    assert corr.keys() == set(combinations(sorted(MODELS), 2)) == diff.keys() == lead.keys() == close.keys()
    blocks = []
    for (m, fold, s, block), g in _groups(cache, lambda r: (r.model, r.fold, r.series_id, (r.step - 1) // 2)).items():
        known = [r.y for r in g if r.y is not None]
        if len(g) == 2:
            blocks.append({"model": m, "fold": fold, "series_id": s, "block": block, "p50": sum(r.p50 for r in g), "y": sum(known) if known else None})
    pooled, n_close = [], {}
    for a, b in corr:
        day = _pairs(cache, a, b, lambda r: (r["fold"], r["series_id"], r["step"]))
        x, z = [p[1] for p in day], [p[2] for p in day]
        level = [(np.mean([p[1] for p in g]), np.mean([p[2] for p in g])) for g in _groups(day, lambda p: p[0][:2]).values()]
        lx, lz = [p[0] for p in level], [p[1] for p in level]
        assert same(corr[a, b], (_corr(x, z), _corr(_ranks(x), _ranks(z)), _corr(lx, lz), _corr(_ranks(lx), _ranks(lz)), *_within(day, lambda p: p[0][:2])))
        assert same(diff[a, b], _errors(day))
        pooled.append(_corr(x, z))
        whole = _pairs(blocks, a, b, lambda r: (r["fold"], r["series_id"], r["block"]))
        want = [y for p, key in ((day, lambda p: p[0][:2]), (whole, lambda p: p[0][1])) for y in (_corr([q[1] for q in p], [q[2] for q in p]), *_errors(p)[1:], *_within(p, key))]
        assert same(lead[a, b], want)
        near = {}
        for k, g in _groups(day, lambda p: p[0][:2]).items():
            u, v = sum(p[1] for p in g), sum(p[2] for p in g)
            near[k] = u == v == 0 or abs(u - v) / ((u + v) / 2) < 0.05
        n_close[a, b] = near
        assert same(close[a, b], [np.mean(list(near.values()))])
    keys = next(iter(n_close.values()))
    summary = (np.mean([all(n[k] for n in n_close.values()) for k in keys]), np.mean([any(n[k] for n in n_close.values()) for k in keys]), len(keys))
    assert same(tuple(metrics.close_summary(made).first()), summary)
    assert same(tuple(metrics.headline(made).first()), (len(corr), sum(r > 0.95 for r in pooled), min(pooled), max(pooled), *summary))


def test_counted_ranks_equal_ranks_of_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(v), int(rng.integers(1, 50))) for g in range(3) for v in range(700)]
    got = {(r.g, r.v): r.k for r in counted_ranks(spark.createDataFrame(rows, "g int, v double, n long").repartition(5), "g", "v", "n", "k").collect()}
    for g in range(3):
        before = 0
        for _, v, n in (r for r in rows if r[0] == g):
            assert got[g, v] == before + (n + 1) / 2
            before += n


@pytest.mark.parametrize("name", ["leadtime_comparison", "mean_abs_diff", "pairwise_correlation", "divergence_headline", "close_fractions"])
def test_no_rows_of_forecasts_are_written_or_joined(spark, monkeypatch, name):
    import __spark_entry__
    from stockwright.sources.scratch import Scratch

    kept, keep = [], Scratch.keep

    def counted(self, df, what, options=None):
        out = keep(self, df, what, options)
        kept.append((what, out.count()))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    out = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.select(F.count(F.lit(1))).first()[0]
    n = next(n for what, n in kept if what in ("arrays", "series"))
    forecasts = n * len(registry.LADDER) * WEEKLY.n_folds * WEEKLY.horizon
    assert max(rows for what, rows in kept) < forecasts / 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan or "model" not in plan
