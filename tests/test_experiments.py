"""Grids, findings, audits and weekly cleaning, against loops on small frames."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest

from stockwright.functions.mathx import z
from stockwright.grain import WEEKLY
from stockwright.operators import audit, cleaning, decision, economics, findings, grids, sweep

import __spark_entry__ as e


def test_row_sets_and_changes(spark):
    old = spark.createDataFrame([("a", 1.0), (None, 2.0), ("c", 3.0), ("c", 3.0), ("d", None)], "k string, v double")
    new = spark.createDataFrame([("a", 1.5), (None, 2.0), ("d", 4.0), ("x", 0.0)], "k string, v double")
    assert tuple(audit.row_sets(old, new, ["k"]).first()) == (3, 1, 1)
    assert tuple(audit.changes(old, new, ["k"], ["v"]).first()) == ("v", 2, 1, 0.5)  # null keys are rows, but no key to compare by
    assert tuple(audit.row_sets(old.limit(0), new.limit(0), ["k"]).first()) == (0, 0, 0)


def test_a_frozen_table_is_compared_and_refuses_other_rows(spark, tmp_path):
    path = f"file://{tmp_path}/base"
    t = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "k string, v double")
    audit.freeze(t, path)
    kept = t.replace(float("nan"), None)
    assert audit.against(kept, path, ["k"], ["v"]).first()["same"]
    moved = spark.createDataFrame([("a", 1.1), ("b", None)], "k string, v double")
    assert not audit.against(moved, path, ["k"], ["v"]).first()["same"]
    with pytest.raises(ValueError):
        audit.against(t.where("k = 'a'"), path, ["k"], ["v"])


def test_window_buffers_against_loops(spark):
    rng = np.random.default_rng(3)
    ids = [f"s{i}" for i in range(6)]
    first = {(f, s): float(rng.normal()) for f in range(1, 5) for s in ids}
    blocks = {(f, s, k): (float(rng.normal()), float(rng.normal())) for f in range(1, 5) for s in ids for k in range(3)}
    rate = {(f, s): float(i % 2) for f in range(4) for i, s in enumerate(ids)} | {(2, "s1"): 0.0}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    observed = grids.windows(
        frame([(f, "m", s, v) for (f, s), v in first.items()], "fold int, model string, series_id string, residual double"),
        frame([("m", f, s, k, p, y) for (f, s, k), (p, y) in blocks.items()], "model string, fold int, series_id string, block int, p50 double, y double"), 4,
    )
    means = frame([(f, "m", s, 1.0, 0.0) for f in range(1, 5) for s in ids], "fold int, model string, series_id string, mean double, std double")
    sigma = frame([(f, "m", s, 1.0) for f in range(1, 5) for s in ids], "fold int, model string, series_id string, sigma double")
    stats = frame([(f, s, v, 1.0) for (f, s), v in rate.items()], "fold int, series_id string, zero_rate double, volume double")
    got = {(r.window, r.fold, r.series_id): r.reorder_point for r in grids.window_policies(means, sigma, observed, stats, 0.95, ("intermittency",)).collect()}
    assert len(got) == 3 * 4 * 6
    for (window, fold, s), value in got.items():
        source = 0 if window == "single" else fold - 1
        peers = [x for x in ids if rate[source, x] == rate[source, s]]
        if window == "all_windows" and fold > 1:
            seen = [blocks[source, x, k][1] - blocks[source, x, k][0] for x in peers for k in range(3)]
        else:
            seen = [first[1 if window == "single" else fold, x] for x in peers]
        assert value == pytest.approx(1 + z(0.95) * np.std(seen, ddof=1))


def test_margins_are_a_projection(spark):
    rows = spark.createDataFrame([(2, 0.0, "m", f, 10.0 * f, 3.0, 1.0, 4, 1, 4, 9.0, 10.0) for f in (1, 2)], "lead int, lot_multiple double, model string, fold int, unit_price double, stocked double, lost double, cycles int, stockouts int, orders int, shipped double, demanded double")
    got = {r.margin: r for r in grids.cell_summary(grids.margin_rows(rows, 0.26, WEEKLY, (0.2, 0.5)), ("margin",)).collect()}
    assert got[0.2].holding_cost == pytest.approx(np.mean([0.26 / 52 * 0.8 * 3 * p for p in (10, 20)])) and got[0.5].stockout_cost == pytest.approx(0.5 * 15)
    assert (got[0.2].csl, got[0.2].fill) == (pytest.approx(0.75), pytest.approx(0.9))


def test_findings(spark):
    savings = lambda *hi: spark.createDataFrame([(f"m{i}", -10.0, -12.0, h) for i, h in enumerate(hi)], "model string, point double, ci_lo double, ci_hi double")
    cost = spark.createDataFrame([("m0", 5.0), ("m1", 8.0), ("m2", 100.0)], "model string, cost double")
    assert tuple(findings.policy_over_model(savings(-1.0, -2.0), cost, ["m0", "m1"]).first()) == (10.0, True, 3.0, True)
    assert not findings.policy_over_model(savings(-1.0, 0.5), cost, ["m0", "m1"]).first()["replicated"]
    assert not findings.policy_over_model(savings(-1.0), cost, ["m0", "m2"]).first()["replicated"]
    assert not findings.policy_over_model(savings(-1.0).limit(0), cost, ["m0"]).first()["replicated"]
    pairs = spark.createDataFrame([(-1.0, 1.0), (0.5, 2.0), (None, None)], "ci_lo double, ci_hi double")
    assert tuple(findings.ties(pairs).first()) == (3, 1, False)
    intervals = spark.createDataFrame([("a", 0.94), ("b", 0.96)], "model string, covered_by_s double")
    cycles = spark.createDataFrame([("a", 100, 20, 8)], "model string, cycles int, stockouts int, sizing int")
    r = findings.coverage_finding(intervals, cycles, 0.95).first()
    assert r.replicated and r.undershoot_share == pytest.approx(0.6) and r.gap == pytest.approx(0.15)


def test_breakeven_equals_bisection(spark):
    parts = spark.createDataFrame([(0.0, "a", 100.0, 5.0), (0.0, "b", 60.0, 21.0)], "lot_multiple double, model string, holding_per_rate double, stockout double")
    rate = economics.breakevens(parts).first()["rate"]
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 100 * mid + 5 < 60 * mid + 21 else (lo, mid)
    assert rate == pytest.approx(lo)


def test_targets_are_distinct_and_rise():
    ids = [sweep.target_id(t) for t in sweep.TARGETS]
    assert len(ids) == 27 and ids == sorted(set(ids))


def test_whole_weeks():
    monday = date(2025, 1, 6)
    assert cleaning.whole_weeks(monday, monday + timedelta(days=13)) == (monday, monday + timedelta(days=7))
    assert cleaning.whole_weeks(monday + timedelta(days=1), monday + timedelta(days=12)) == (monday + timedelta(days=7), monday)


def test_clean_weekly_against_a_loop(spark, tmp_path):
    day = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    orders = {1: 7, 2: 7, 3: 8, 4: 7}
    lines = [(1, 1, 5.0, "N", 2), (1, 2, 4.0, "N", 7), (2, 3, 6.0, "N", 12), (4, 1, 8.0, "R", 20), (3, 1, 2.0, "N", 13), (3, 1, 9.0, "N", 29), (2, 2, 1.0, "N", 33)]
    d = f"file://{tmp_path}"
    spark.createDataFrame([(o, p, k, q, q * 2, flag, day(n)) for k, (o, p, q, flag, n) in enumerate(lines)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(list(orders.items()), "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    got = {(r.stock_code, r.week): (r.units, r.n_lines) for r in e.queries()["clean_weekly"](spark, d).collect()}
    # 2025-01-03 to 2025-02-03: the first whole week starts on 6 January, the last on 27 January;
    # the cancellation of eight takes customer 7's five, and has no more to take
    monday = lambda m, n: date(2025, m, n)
    assert got == {("00002", monday(1, 6)): (4.0, 1), ("00003", monday(1, 13)): (6.0, 1), ("00001", monday(1, 13)): (2.0, 1), ("00001", monday(1, 27)): (9.0, 1)}


def test_every_policy_covers_more_at_a_higher_target(spark):
    stats = spark.createDataFrame([(1, "m", "s", 10.0, 4.0), (1, "m", "t", 0.0, 0.0)], "fold int, model string, series_id string, mean double, std double")
    for policy in decision.POLICIES.values():
        low, high = [{r.series_id: r.reorder_point for r in policy(stats, t).collect()} for t in (0.8, 0.99)]
        assert low["s"] < high["s"] and low["t"] == high["t"] == 0
