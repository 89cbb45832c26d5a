"""Hand-computed cases."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwright.functions import mathx
from stockwright.grain import DAILY, WEEKLY, for_track
from stockwright.operators import cleaning, decision, economics, features, hierarchy, metrics, monitor, simulate
from stockwright.operators.economics import Costs

D0 = date(2025, 1, 6)


def day(i, step=1):
    return D0 + timedelta(days=i * step)


def test_normal_distribution(spark):
    x = [(float(v),) for v in np.linspace(-8, 8, 161)]
    got = spark.createDataFrame(x, "x double").select("x", mathx.norm_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * math.erfc(-r.x / 2**0.5)) for r in got) < 1e-14


@pytest.mark.parametrize("n", [2, 7, 10, 33, 300])
@pytest.mark.parametrize("parts", [3, 5, 10])
def test_cut_rank_is_qcut(spark, n, parts):
    df = spark.range(1, n + 1).select(F.col("id").alias("r"), F.lit(n).alias("n"))
    got = {r.r: r.c for r in df.select("r", mathx.cut_rank(F.col("r"), F.col("n"), parts).alias("c")).collect()}
    want = pd.qcut(pd.Series(range(1, n + 1)), parts, labels=False) + 1
    assert [got[i] for i in range(1, n + 1)] == want.tolist()


def test_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double").withColumn("k", F.lit(0))
    got = df.select("v", mathx.average_rank(Window.partitionBy("k").orderBy("v"), Window.partitionBy("k", "v")).alias("r")).collect()
    assert sorted(r.r for r in got) == [1.0, 2.5, 2.5, 4.0]


def test_pinball_and_coverage(spark):
    df = spark.createDataFrame([(10.0, 11.0)], "y double, p double")
    assert df.agg(metrics.pinball(F.col("y"), F.col("p"), 0.1)).first()[0] == pytest.approx(0.9)
    df = spark.createDataFrame([(5.0,), (15.0,), (10.0,)], "y double")
    assert df.agg(metrics.coverage(F.col("y"), F.lit(0.0), F.lit(10.0))).first()[0] == pytest.approx(2 / 3)


def test_mase_and_rmsse(spark):
    scales = spark.createDataFrame([(1, "a", 1.0, 1.0)], "fold int, series_id string, scale_mae double, scale_mse double")
    cache = spark.createDataFrame([(1, "m", "a", 10.0, 9.0), (1, "m", "a", 11.0, 11.0), (1, "m", "a", 12.0, 15.0)], "fold int, model string, series_id string, y double, p50 double")
    r = metrics.per_series(cache, scales).first()
    assert (r.mase, r.rmsse) == (pytest.approx(4 / 3), pytest.approx(math.sqrt(10 / 3)))


def sim(spark, demand, s, up_to, start, lead):
    df = spark.createDataFrame([(demand, float(s), float(up_to), float(start))], "d array<double>, s double, u double, h double")
    return df.select(simulate.run(F.col("d"), F.col("s"), F.col("u"), F.col("h"), lead).alias("r")).first().r


def test_simulator(spark):
    r = sim(spark, [1.0, 1.0, 1.0, 1.0], 0, 0, 10, 2)
    assert (r.shipped, r.stocked, r.lost, r.orders) == (4, 9 + 8 + 7 + 6, 0, 0)
    r = sim(spark, [10.0, 10.0], 0, 0, 5, 2)
    assert (r.shipped, r.lost) == (5, 15)
    r = sim(spark, [8.0, 5.0, 0.0, 0.0], 8, 8, 8, 2)
    assert (r.cycles, r.stockouts, r.shipped, r.demanded) == (1, 1, 8, 13)
    r = sim(spark, [8.0, 0.0, 0.0, 0.0], 8, 8, 8, 5)
    assert (r.cycles, r.orders) == (0, 1)


def oracle_sim(demand, s, up_to, stock, lead):
    due = None
    c = dict(cycles=0, stockouts=0, sizing=0, orders=0, shipped=0.0, lost=0.0, stocked=0.0, qty=0.0)
    short, exposure = False, 0.0
    for t, d in enumerate(demand):
        if due and due[0] == t:
            stock += due[1]
            due = None
            c["cycles"] += 1
            c["stockouts"] += short
            c["sizing"] += short and exposure > s + 1e-9
        sold = min(stock, d)
        if due:
            exposure += d
            short = short or d > sold
        stock -= sold
        c["shipped"] += sold
        c["lost"] += d - sold
        c["stocked"] += stock
        if stock < s and due is None and up_to > stock:
            due, short, exposure = (t + lead, up_to - stock), False, 0.0
            c["orders"] += 1
            c["qty"] += up_to - stock
    return c


def test_simulator_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.poisson(3, 30)], float(rng.integers(0, 12)), float(rng.integers(0, 10)), float(rng.integers(0, 15))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, d array<double>, s double, q double, h double").withColumn("r", simulate.run(F.col("d"), F.col("s"), F.col("s") + F.col("q"), F.col("h"), 3))
    got = {x.i: x.r for x in df.collect()}
    for i, d, s, q, h in rows:
        want = oracle_sim(d, s, s + q, h, 3)
        assert {k: getattr(got[i], k) for k in want} == want, i


def test_reprice_equals_pricing_anew(spark):
    rows = spark.createDataFrame([("a", 2.0, 30.0, 4.0, 2.0, 10.0, 13), ("b", 5.0, 12.0, 1.0, 8.0, 9.0, 13)], "series_id string, unit_price double, stocked double, lost double, shipped double, demanded double, n_periods int")
    old = simulate.priced(rows, Costs(), WEEKLY)
    for new in (Costs(0.5, 0.4), Costs(0.1, None, 3.0)):
        want = {r.series_id: r.total_cost for r in simulate.priced(rows, new, WEEKLY).collect()}
        got = {r.series_id: r.total_cost for r in economics.reprice(old, new, WEEKLY).collect()}
        assert got == pytest.approx(want)


def test_lead_time_stats_and_decision(spark):
    f = spark.createDataFrame([(1, "m", "a", i, 8.0, 10.0, 12.0) for i in (1, 2, 3)], "fold int, model string, series_id string, step int, p10 double, p50 double, p90 double")
    r = decision.lead_time_stats(f, 3).first()
    assert (r["mean"], r["std"]) == (30.0, pytest.approx(math.sqrt(3) * 2 / mathx.Z90))
    stats = spark.createDataFrame([("a", 30.0, 4.0, 0.0)], "series_id string, mean double, std double, on_hand double")
    buffers = spark.createDataFrame([("a", 7.0)], "series_id string, safety_stock double")
    d = decision.decide(stats, 0.95, 3, buffers, 2.0).first()
    assert (d.reorder_point, d.order_up_to, d.order_quantity) == (37.0, 97.0, 97.0)
    assert d.rationale == "On-hand (0) covers 0.0 days of expected demand (10.0/day); lead time is 3 days at 95% service level → order 97 units."


def test_missing_forecast_makes_the_mean_missing(spark):
    f = spark.createDataFrame([(1, "m", "a", 1, 8.0, 10.0, 12.0), (1, "m", "a", 2, None, None, None)], "fold int, model string, series_id string, step int, p10 double, p50 double, p90 double")
    assert decision.lead_time_stats(f, 2).first()["mean"] is None


def test_stockout_probability(spark):
    df = spark.createDataFrame([(5.0, 4.0, 0.0), (3.0, 4.0, 0.0), (4.0, 4.0, 2.0)], "h double, m double, s double")
    assert [r[0] for r in df.select(decision.stockout_probability(F.col("h"), F.col("m"), F.col("s"))).collect()] == [0.0, 1.0, 0.5]


def test_fill_rate_k_solves_the_loss_equation(spark):
    df = spark.createDataFrame([(20.0, 6.0), (5.0, 0.0)], "q double, s double").withColumn("k", decision.fill_rate_k(0.95, F.col("q"), F.col("s")))
    got = df.withColumn("g", mathx.standard_loss(F.col("k"))).collect()
    assert got[0].g == pytest.approx(0.05 * 20 / 6) and got[1].k == 0.0


def test_zero_rate_counts_a_missing_first_value(spark):
    y = [0.0, 0.0, 5.0, 0.0, 5.0]
    df = spark.createDataFrame([("a", day(i), v, 10.0) for i, v in enumerate(y)], "series_id string, date date, y double, price double")
    last = features.build(df, DAILY).orderBy(F.desc("date")).first()
    assert last.roll_zero_rate_7 == pytest.approx(3 / 5)


def test_features_do_not_see_the_present(spark):
    y = [float(i % 5) for i in range(40)]
    rows = lambda ys: spark.createDataFrame([("a", day(i), v, 10.0) for i, v in enumerate(ys)], "series_id string, date date, y double, price double")
    cols = [c for c in features.columns(features.build(rows(y), DAILY), DAILY) if c != "price"]
    at = lambda ys: features.build(rows(ys), DAILY).where(F.col("date") <= F.lit(day(30))).select("date", *cols).orderBy("date").collect()
    assert at(y) == at(y[:30] + [99.0] * 10)


def invoices(spark, rows):
    return spark.createDataFrame([(i, n, c, date_, q, p, k) for n, (i, c, date_, q, p, k) in enumerate(rows)], "invoice string, line int, stock_code string, invoice_date timestamp, quantity double, price_gbp double, customer string")


def test_netting_takes_the_latest_sale_first(spark):
    from datetime import datetime as dt

    rows = [("1", "12345", dt(2010, 3, 1), 10.0, 1.0, "k"), ("2", "12345", dt(2010, 3, 8), 10.0, 1.0, "k"), ("C3", "12345", dt(2010, 3, 9), -12.0, 1.0, "k")]
    got = cleaning.net_cancellations(invoices(spark, rows)).select("invoice", "quantity").collect()
    assert [tuple(r) for r in got] == [("1", 8.0)]
    s = cleaning.netting_stats(invoices(spark, rows)).first()
    assert (s.cancelled_units, s.matched_units, s.unmatched_units) == (12.0, 12.0, 0.0)


@pytest.mark.parametrize("when,who", [((2010, 8, 1), "k"), ((2010, 3, 9), "other"), ((2010, 3, 9), None)])
def test_netting_without_a_match_keeps_the_sale(spark, when, who):
    from datetime import datetime as dt

    rows = [("1", "12345", dt(2010, 3, 1), 10.0, 1.0, "k"), ("C3", "12345", dt(*when), -11.0, 1.0, who)]
    got = cleaning.net_cancellations(invoices(spark, rows)).collect()
    assert [(r.invoice, r.quantity) for r in got] == [("1", 10.0)]
    assert cleaning.netting_stats(invoices(spark, rows)).first().unmatched_units == 11.0


def test_drift_with_constant_baseline(spark):
    base = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 0.0)], "series_id string, y double")
    recent = spark.createDataFrame([("a", 5.0), ("b", 0.0)], "series_id string, y double")
    assert [r.series_id for r in monitor.input_drift(base, recent).collect()] == ["a"]


def test_rolling_mase(spark):
    log = spark.createDataFrame([("a", day(i), float(v), 0.0) for i, v in enumerate([0, 0, 0, 5, 5, 5])], "series_id string, date date, y double, forecast double")
    r = monitor.rolling_mase(monitor.realised_error(log), spark.createDataFrame([("a", 2.0)], "series_id string, scale double"), 3).orderBy("date").collect()
    assert (r[0].rolling_mase, r[-1].rolling_mase) == (0.0, 2.5)


def test_hierarchy_and_min_trace(spark):
    bottom = spark.createDataFrame([("CA", "x", D0, 1.0), ("CA", "y", D0, 3.0), ("TX", "z", D0, 5.0)], "state string, item string, date date, y double")
    got = {r.node: r.y for r in hierarchy.totals(bottom, ("state", "item")).collect()}
    assert got == {"CA": 4.0, "TX": 5.0, "CA/x": 1.0, "CA/y": 3.0, "TX/z": 5.0}
    edges = hierarchy.edges(bottom, ("state", "item"))
    nodes = [(lv, n) for lv, n in spark.createDataFrame(edges.select("level", "node").distinct().collect()).collect()]
    f = spark.createDataFrame([(int(lv), n, D0, got[n] + 1.0) for lv, n in nodes], "level int, node string, date date, p50 double")
    e = spark.createDataFrame([(int(lv), n, day(i), float((i * 7 + len(n)) % 5 - 2)) for lv, n in nodes for i in range(8)], "level int, node string, date date, e double")
    out = {r.node: r.p50 for r in hierarchy.min_trace(f, e, edges).collect()}
    assert out["CA"] == pytest.approx(out["CA/x"] + out["CA/y"]) and out["TX"] == pytest.approx(out["TX/z"])


def test_config_and_grain():
    assert for_track("b") is WEEKLY and WEEKLY.periods_in(D0, day(2, 7)) == 3
    c = economics.load_config(WEEKLY, {"STOCKOUT_PENALTY_PER_UNIT": "4"})
    assert c.costs.margin is None and c.costs.flat_penalty == 4.0 and c.lead == 2
    with pytest.raises(ValueError):
        economics.load_config(WEEKLY, {"STOCKOUT_PENALTY_PER_UNIT": "4", "GROSS_MARGIN": "0.2"})
