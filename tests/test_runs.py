"""Grids summed where series are simulated, against their runs as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwright.functions.mathx import standard_loss, loss_of, z
from stockwright.functions.ranks import counted_percentiles, percentiles
from stockwright.grain import WEEKLY
from stockwright.operators import decision, folds, grids, metrics, runs, simulate, sweep
from stockwright.operators.models import registry
from stockwright.plans.experiments import LOTS, _run
from stockwright.plans.queries import COSTS, LEAD, LEVEL, Base

D = "/root/testdata/sf0.001"


def _same(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, w in want.items():
        for c, x in w.asDict().items():
            assert got[k][c] == (x if x is None or isinstance(x, str) else pytest.approx(x, rel=1e-9, abs=1e-9)), (k, c)


def test_schemes_equal_their_rows(spark):
    b, keys = Base(spark, D), ("form", "granularity", "fold", "model", "lot_multiple")
    got = simulate.pooled_sums(runs.schemes(b.grid, grids.SCHEMES, LEVEL, LOTS, COSTS), keys)
    _same(got, simulate.pooled(_run(b, grids.scheme_policies(b.lead_means, b.sigma, b.chained, b.stats, LEVEL)), keys), keys)


def test_windows_equal_their_rows(spark):
    b, keys = Base(spark, D), ("window", "pooling", "fold", "model")
    got = simulate.pooled_sums(runs.windows(b.grid, grids.WINDOWS, grids.POOLINGS, LEVEL, (2.0,), COSTS), keys)
    rows = folds.fold_rows(b.end, WEEKLY)
    stats = registry.training_stats(b.arrays, [(0, WEEKLY.before(rows[0][1], LEAD)), *rows[:-1]], WEEKLY.mase_lag, WEEKLY).select("fold", "series_id", "zero_rate", "volume")
    p = grids.window_policies(b.lead_means, b.sigma, grids.windows(b.chained, metrics.lead_time_blocks(b.cache, LEAD), WEEKLY.n_folds), stats, LEVEL)
    _same(got, simulate.pooled(_run(b, p, (2.0,)), keys), keys)


def test_sweep_and_targets_equal_their_rows(spark):
    b = Base(spark, D)
    sums = runs.swept(b.grid, [(sweep.target_id(t), z(t)) for t in sweep.TARGETS], LOTS, COSTS).withColumnsRenamed({f"_{c}": c for c in ("stockouts", "shipped", "demanded")})
    _same(sweep.curve_of(sums), sweep.curves(b.swept), ("target_id", "lot_multiple", "model"))
    keys = ("policy", "fold", "model", "lot_multiple")
    stats = b.lead_means.drop("std").join(b.sigma.withColumnRenamed("sigma", "std"), grids.KEYS)
    parts = [policy(stats, LEVEL).drop("k").withColumn("policy", F.lit(name)) for name, policy in decision.POLICIES.items()]
    got = simulate.pooled_sums(runs.targets_met(b.grid, list(decision.POLICIES), LEVEL, LOTS, COSTS), keys)
    _same(got, simulate.pooled(_run(b, parts[0].unionByName(parts[1])), keys), keys)


@pytest.mark.parametrize("name", ["scheme_grid", "posthoc_buffers", "sweep_dominance", "fill_rate_simulated"])
def test_runs_are_no_rows(spark, monkeypatch, name):
    """The simulator steps a batch's runs without a row for each of them."""
    import __spark_entry__

    def row_by_row(*_):
        raise AssertionError("a row for each run")

    monkeypatch.setattr(simulate, "run", row_by_row)
    assert __spark_entry__.queries()[name](spark, D).count()


def test_percentiles_of_counts_equal_those_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{g}", float(np.round(rng.normal(), 1)), 1) for g, n in enumerate((1, 2, 900, 40)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(4)
    want = {r.g: r.q for r in percentiles(df, ["g"], "v", {"q": 0.95}).collect()}
    counts = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    assert {r.g: pytest.approx(r.q) for r in counted_percentiles(counts, "g", "v", "n", {"q": 0.95}).collect()} == want


def test_losses_and_factors_equal_their_columns(spark):
    k = np.linspace(-40, 40, 401)
    rows = [(float(x), float(q), float(s)) for x, q, s in zip(k, np.abs(k) * 3, np.arange(401) % 7, strict=True)]
    df = spark.createDataFrame(rows, "k double, q double, s double").select(standard_loss(F.col("k")), decision.fill_rate_k(0.95, F.col("q"), F.col("s")))
    want = np.array([tuple(r) for r in df.collect()], float)
    assert np.allclose(loss_of(k), want[:, 0], atol=1e-12)
    assert np.allclose(decision.fill_rate_factors(0.95, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])), want[:, 1], atol=1e-9)


def test_kept_states_equal_models_from_the_start():
    """A later origin goes on from an earlier one, an earlier one starts anew."""
    import pyarrow as pa
    from datetime import date

    rng = np.random.default_rng(3)
    ys = np.where(rng.random((50, 80)) < 0.7, 0.0, rng.integers(1, 9, (50, 80))).astype(float)
    made = pa.RecordBatch.from_pydict({"series_id": [f"s{i}" for i in range(50)], "start": pa.array([date(1970, 1, 5)] * 50), "ys": pa.array(ys.tolist(), pa.list_(pa.float64()))})
    b = registry._Batch(made, WEEKLY)
    for weeks in (30, 60, 45, 80, 30):
        for name in registry.LADDER:
            assert np.array_equal(b.points(name, 4 + 7 * (weeks - 1), 3, WEEKLY), registry.LOCAL[name](ys[:, :weeks], 3, WEEKLY)), (name, weeks)
