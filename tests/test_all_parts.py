"""Queries on the mixed panel with one series for every part, against loops."""

from datetime import date, datetime, timedelta

import pytest

import __spark_entry__ as e

MONDAY = date(2000, 1, 3)
PARTS = (5, 149, 150, 12345, 123456, 123457)  # lpad to five places would make one of the last three


@pytest.fixture(scope="module")
def sold(spark, tmp_path_factory):
    """(folder, {part: {week: units}}) of 120 weeks."""
    d = f"file://{tmp_path_factory.mktemp('parts')}"
    units = {p: {w: float(1 + (w + k) % 5) for w in range(120) if w % (k + 2) == 0 or w in (0, 119)} for k, p in enumerate(PARTS)}
    lines = [(1, p, 1, 1, y, 2 * y, 0.0, 0.0, "N", "O", datetime(2000, 1, 4) + timedelta(weeks=w)) for p, v in units.items() for w, y in v.items()]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, "x", f"B{p % 2}", "T", 1, 1.0) for p in PARTS], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return d, units


def test_zero_rates_and_scales_of_every_part(spark, sold):
    d, units = sold
    q = e.queries()
    ends = {r.fold: (r.train_end - MONDAY).days // 7 for r in q["folds_weekly"](spark, d).collect()}
    rates = {(r.fold, r.series_id): (r.zero_rate, r.volume) for r in q["zero_rates"](spark, d).collect()}
    scales = {(r.fold, r.series_id): r.scale_mae for r in q["insample_scales"](spark, d).collect()}
    from stockwright.grain import WEEKLY

    lag = WEEKLY.mase_lag
    assert {s for _, s in rates} == {f"P{p:05d}" for p in PARTS} | {"B0|T", "B1|T"}
    for p, v in units.items():
        for fold, end in ends.items():
            y = [v.get(w, 0.0) for w in range(end + 1)]
            steps = [abs(a - b) for a, b in zip(y[lag:], y, strict=False)]
            assert rates[fold, f"P{p:05d}"] == (pytest.approx(y.count(0.0) / len(y), abs=1e-6), pytest.approx(sum(y) / len(y), abs=1e-6))
            assert scales[fold, f"P{p:05d}"] == pytest.approx(sum(steps) / len(steps), abs=1e-6)


def test_prices_are_carried_over_gaps(spark, sold):
    d, units = sold
    ends = {r.fold: (r.train_end - MONDAY).days // 7 for r in e.queries()["folds_weekly"](spark, d).collect()}
    got = {(r.fold, r.series_id): r.weight for r in e.queries()["revenue_weights"](spark, d).collect()}
    for p, v in units.items():  # every line costs 2 a unit
        for fold, end in ends.items():
            assert got[fold, f"P{p:05d}"] == pytest.approx(2 * sum(v.get(w, 0.0) for w in range(end - 12, end + 1)))


def test_product_codes_of_large_part_keys(spark):
    from stockwright.sources.tables import stock_code
    from pyspark.sql import functions as F

    keys = [7, 99_999, 100_000, 2_600_001, 2_700_000, 70_100_000]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(stock_code(F.col("k"))).collect()]
    assert got == ["00007", "99999", "00000A", "00001Z", "00000AA", "00000ZY"]
