"""Models, serving, bootstrap and the driver contract on small panels."""

import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwright.functions.mathx import Z90, z
from stockwright.grain import DAILY, WEEKLY
from stockwright.operators import bootstrap, serve
from stockwright.operators.models import registry
from stockwright.operators.models.fitted import auto_ets, auto_theta
from stockwright.sources import sinks

ROOT = Path(__file__).resolve().parents[1]
D0 = date(2025, 1, 1)


@pytest.fixture(scope="module")
def paper(spark):
    """Two series of 70 days: always 2, and 4 and 0 in turn."""
    rows = [(s, D0 + timedelta(days=i), float(y), 2.0) for i in range(70) for s, y in (("flat", 2), ("wave", 4 if i % 2 == 0 else 0))]
    return spark.createDataFrame(rows, "series_id string, date date, y double, price double")


def test_served_paper_example(spark, paper):
    c = serve.fit_calibration(paper, 7, 0.95, DAILY)
    r = {x.series_id: x for x in serve.reorder(paper, c, 7, DAILY).collect()}
    ss = z(0.95) * 2**0.5
    assert r["flat"]["mean"] == pytest.approx(14) and r["flat"].safety_stock == pytest.approx(ss)
    assert r["flat"].order_up_to == pytest.approx(14 + ss + 28)
    band = c.interval(serve.forecast(paper, ["flat"], 7, DAILY)).first()
    assert (band.p10, band.p90) == (pytest.approx(2 - Z90 * 2**0.5 / 7**0.5), pytest.approx(2 + Z90 * 2**0.5 / 7**0.5))


def test_serving_refuses_what_does_not_fit(spark, paper):
    c = serve.fit_calibration(paper, 7, 0.95, DAILY)
    with pytest.raises(serve.Mismatch):
        serve.reorder(paper, c, 5, DAILY)
    with pytest.raises(serve.UnknownSeries):
        serve.forecast(paper, ["nope"], 7, DAILY)


def test_croston_and_tsb_against_loops(spark):
    rng = np.random.default_rng(0)
    ys = {f"s{i}": [float(v) for v in rng.poisson(0.6, 60)] for i in range(6)} | {"none": [0.0] * 60}
    rows = [(s, D0 + timedelta(days=i), y) for s, v in ys.items() for i, y in enumerate(v)]
    a = registry.arrays(spark.createDataFrame(rows, "series_id string, date date, y double"))
    origins = spark.createDataFrame([(D0 + timedelta(days=59),)], "train_end date")
    got = {(r.series_id, r.model): r.p50 for r in registry.points(a, origins, ["CrostonClassic", "CrostonSBA", "TSB"], 3, DAILY).where("step = 2").collect()}
    for s, v in ys.items():
        size = gap = p = None
        since = 0
        for y in v:
            since += 1
            hit = float(y > 0)
            p = hit if p is None else p + 0.1 * (hit - p)
            if y > 0:
                size = y if size is None else size + 0.1 * (y - size)
                gap = since if gap is None else gap + 0.1 * (since - gap)
                since = 0
        c = size / gap if size else 0.0
        assert got[s, "CrostonClassic"] == pytest.approx(c) and got[s, "CrostonSBA"] == pytest.approx(0.95 * c)
        assert got[s, "TSB"] == pytest.approx(p * size if size else 0.0)


def test_fitted_models_follow_a_line_and_a_season():
    t = np.arange(60.0)
    assert abs(auto_theta(10 + t[None, :], 3, WEEKLY) - (10 + np.arange(60, 63))).max() < 3
    season = np.tile([0.0, 5.0, 10.0, 5.0, 0.0, 20.0, 30.0], 10)
    both = auto_ets(np.stack([season, 0 * season + 4.0]), 7, DAILY)
    assert abs(both[0] - season[:7]).max() < 3 and abs(both[1] - 4.0).max() < 1e-6
    with pytest.raises(ValueError):
        registry.check(["NBEATS"])


def test_fitted_model_through_the_registry(spark, paper):
    p = registry.points(registry.arrays(paper), spark.createDataFrame([(D0 + timedelta(days=69),)], "train_end date"), ["AutoETS", "MovingAverage"], 2, DAILY)
    assert {(r.model, r.step) for r in p.collect()} == {(m, s) for m in ("AutoETS", "MovingAverage") for s in (1, 2)}


def test_bootstrap_is_the_seeded_one(spark):
    rng = np.random.default_rng(1)
    ids = [f"s{i:02d}" for i in range(20)]
    va, vb = rng.normal(size=(20, 2)), rng.normal(size=(20, 2))
    frame = lambda v: spark.createDataFrame([(s, f, float(v[i, f])) for i, s in enumerate(ids) for f in (0, 1)], "series_id string, fold int, v double")
    r = bootstrap.difference(frame(va), frame(vb), "v", draws=300).first()
    d = (va - vb).mean(axis=1)
    draws = d[np.random.default_rng(0).integers(0, 20, (300, 20))].sum(axis=1)
    assert r.point == pytest.approx(d.sum())
    assert (r.ci_lo, r.ci_hi) == (pytest.approx(np.quantile(draws, 0.025)), pytest.approx(np.quantile(draws, 0.975)))
    assert r.crosses_zero == (np.quantile(draws, 0.025) <= 0 <= np.quantile(draws, 0.975))


def test_resume_runs_only_what_is_missing(spark, tmp_path):
    path, ran = f"file://{tmp_path}/grid", []

    def run(todo):
        ran.append(sorted(r.t for r in todo.collect()))
        return todo.withColumn("v", F.col("t") * 2)

    grid = lambda *t: spark.createDataFrame([(x,) for x in t], "t int")
    sinks.resume(grid(1, 2), path, ["t"], run)
    assert sinks.resume(grid(1, 2, 3), path, ["t"], run).count() == 3 and ran == [[1, 2], [3]]


def test_json_has_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "b double, a int")
    assert df.select(sinks.json_column(df)).first()[0] == '{"a":1,"b":null}'


def test_streaming_rolling_error(spark, tmp_path):
    from stockwright.streaming import monitor

    src = f"file://{tmp_path}/log"
    rows = [("a", D0 + timedelta(days=i), float(i), 0.0) for i in range(6)]
    spark.createDataFrame(rows, "series_id string, date date, y double, forecast double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("series_id string, date date, y double, forecast double").parquet(src)
    q = monitor.rolling_error(stream, "3 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("rolling").start()
    q.processAllAvailable()
    q.stop()
    got = {r.window_start: r.mae for r in spark.table("rolling").collect()}
    assert got[D0 + timedelta(days=1)] == pytest.approx((1 + 2 + 3) / 3)


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "stockwright", tmp_path / "stockwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-2]) > 50


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
