"""DuckDB SQL for the queries of ``experiments``."""

from __future__ import annotations

from ..grain import WEEKLY as G
from ..operators import findings, grids
from ..operators.economics import HOLDING, MARGIN
from ..operators.sweep import target_id
from .experiments import CHECKED, CLUSTER, RATES
from .oracle import BODY, CHAIN, EXTRA, L, LEVEL, Z95, _sim, chain, cut, d, r, rs

COLUMN = {"intermittency": "intermittency", "volume_quintile": "quintile", "volume_tercile_within_intermittency": "tercile"}
IN_CLUSTER = "(" + ", ".join(f"'{m}'" for m in CLUSTER) + ")"
POOLED = f"""count(*) AS n_series, {r('sum(holding_cost)', 'holding_cost')}, {r('sum(stockout_cost)', 'stockout_cost')}, {r('sum(total_cost)', 'total_cost')}, CAST(sum(cycles) AS BIGINT) AS cycles, {r('avg(safety_stock / nullif(std, 0))', 'mean_safety_factor')},
  {r('CASE WHEN sum(demanded) > 0 THEN sum(shipped) / sum(demanded) ELSE 1.0 END', 'fill_rate')}, {r('1 - sum(stockouts) / nullif(CAST(sum(cycles) AS DOUBLE), 0)', 'csl')}, {r(f'sum(shipped) / nullif(sum(stocked / {G.horizon}), 0)', 'turns')}"""


def _cells(source: str, keys: str) -> str:
    """Sums by fold, their means over folds, service pooled."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("holding_cost", "stockout_cost", "total_cost", "cycles", "orders", "stockouts", "shipped", "demanded"))
    means = ", ".join(r(f"avg({c})", c) for c in ("holding_cost", "stockout_cost", "total_cost", "cycles", "orders"))
    return f"""SELECT {keys}, model, {means}, {r('1 - sum(stockouts) / nullif(CAST(sum(cycles) AS DOUBLE), 0)', 'csl')}, {r('sum(shipped) / nullif(sum(demanded), 0)', 'fill')}
  FROM (SELECT {keys}, model, fold, {sums} FROM {source} GROUP BY {keys}, model, fold) GROUP BY {keys}, model"""


def _scheme(form: str, granularity: str) -> str:
    agg = f"{d(Z95)} * stddev_samp(residual)" if form == "normal" else f"quantile_cont(residual, {LEVEL})"
    rows = f"(SELECT c.*, b.{COLUMN[granularity]} AS bk FROM chained c JOIN buckets b ON b.fold = c.fold AND b.series_id = c.series_id)"
    return f"""SELECT c.fold, c.model, c.series_id, '{form}' AS form, '{granularity}' AS granularity, coalesce(t.ss, e.ss) AS ss FROM {rows} c
  JOIN (SELECT fold, model, bk, {agg} AS ss FROM {rows} GROUP BY 1, 2, 3) t ON t.fold = c.fold AND t.model = c.model AND t.bk = c.bk
  JOIN (SELECT fold, model, {agg} AS ss FROM chained GROUP BY 1, 2) e ON e.fold = c.fold AND e.model = c.model"""


def _policies(name: str, buffers: str, keys: str, lots: str) -> str:
    """Rows to simulate from buffers (fold, model, series_id, keys, ss)."""
    ks = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT p.fold, p.model, p.series_id, p.mean, p.std, p.unit_price, {ks}, s.ss AS safety_stock, lot AS lot_multiple, round(mean + s.ss, 6) AS s,
   round(mean + s.ss + lot * greatest(mean, 0), 6) AS up_to, round(mean + s.ss + 0.5 * (lot * greatest(mean, 0)), 6) AS start
  FROM pol p JOIN {buffers} s ON s.fold = p.fold AND s.model = p.model AND s.series_id = p.series_id, (VALUES {lots}) m(lot))"""


SCHEMES = " UNION ALL ".join(_scheme(*s) for s in grids.SCHEMES)
BOTH_LOTS, SHIPPED = "(CAST(0 AS DOUBLE)), (CAST(2 AS DOUBLE))", "(CAST(2 AS DOUBLE))"
SCHEME_GRID = f""",
sch AS MATERIALIZED ({SCHEMES}),
{_policies('pols', 'sch', 'form, granularity', BOTH_LOTS)},
{_sim('sdet', 'pols', 'fold, model, series_id, lot_multiple, form, granularity').strip()}
SELECT form, granularity, fold, model, lot_multiple, {POOLED} FROM sdet GROUP BY 1, 2, 3, 4, 5"""

POSTHOC = f""",
src AS (SELECT fold AS source, train_end FROM folds UNION ALL SELECT 0, train_end - {7 * L} FROM folds WHERE fold = 1),
sst AS MATERIALIZED (SELECT source, series_id, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate, avg(y) AS volume FROM units JOIN src ON date <= train_end GROUP BY 1, 2),
lab AS MATERIALIZED (SELECT source, series_id, 'intermittency' AS pooling, CASE WHEN zero_rate > 0.5 THEN 'intermittent' ELSE 'regular' END AS bucket FROM sst
  UNION ALL SELECT source, series_id, 'volume_quintile', 'q' || {cut('rk', 'n', 5)} FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY volume, series_id) AS rk, count(*) OVER (PARTITION BY source) AS n FROM sst)),
obs AS MATERIALIZED (SELECT 'single' AS "window", f.fold, 0 AS source, model, series_id, residual FROM chained c, folds f WHERE c.fold = 1
  UNION ALL SELECT 'first_window', fold, fold - 1, model, series_id, residual FROM chained
  UNION ALL SELECT 'all_windows', 1, 0, model, series_id, residual FROM chained WHERE fold = 1
  UNION ALL SELECT 'all_windows', fold + 1, fold, model, series_id, y - p50 FROM blocks WHERE fold < {G.n_folds}),
lob AS MATERIALIZED (SELECT o.*, l.pooling, l.bucket FROM obs o JOIN lab l ON l.source = o.source AND l.series_id = o.series_id),
buf AS MATERIALIZED (SELECT e.fold, e.model, l.series_id, e."window", l.pooling, {d(Z95)} * coalesce(p.sd, e.sd) AS ss FROM lab l
  JOIN (SELECT "window", fold, source, model, pooling, stddev_samp(residual) AS sd FROM lob GROUP BY 1, 2, 3, 4, 5) e ON e.source = l.source AND e.pooling = l.pooling
  LEFT JOIN (SELECT "window", fold, model, pooling, bucket, stddev_samp(residual) AS sd FROM lob GROUP BY 1, 2, 3, 4, 5) p ON p."window" = e."window" AND p.fold = e.fold AND p.model = e.model AND p.pooling = l.pooling AND p.bucket = l.bucket),
{_policies('polw', 'buf', '"window", pooling', SHIPPED)},
{_sim('wdet', 'polw', 'fold, model, series_id, lot_multiple, "window", pooling').strip()}
SELECT "window", pooling, fold, model, {POOLED} FROM wdet GROUP BY 1, 2, 3, 4"""

_LEADS = " UNION ALL ".join(
    f"SELECT * FROM ({chain(n)} SELECT CAST({n} AS INT) AS lead, lot_multiple, model, fold, sum(unit_price * stocked) AS held, sum(unit_price * lost) AS lost, sum(cycles) AS cycles, sum(stockouts) AS stockouts, sum(orders) AS orders, sum(shipped) AS shipped, sum(demanded) AS demanded FROM det GROUP BY 1, 2, 3, 4)"
    for n in grids.LEADS
)
_PRICED = f"""(SELECT *, holding_cost + stockout_cost AS total_cost FROM (SELECT *, {d(HOLDING / G.periods_per_year)} * (1 - margin) * held AS holding_cost, margin * lost AS stockout_cost
  FROM ({_LEADS}), (VALUES {', '.join(f'({d(m)})' for m in grids.MARGINS)}) g(margin)))"""

BY_RATE = f"""(SELECT g.rate, lot_multiple, target_id, v * g.rate / {G.periods_per_year} + so AS cost FROM (SELECT target_id, lot_multiple, avg(v) AS v, avg(so) AS so FROM
  (SELECT target_id, lot_multiple, model, avg(v) AS v, avg(so) AS so FROM (SELECT target_id, lot_multiple, model, fold, sum(stocked * (unit_price * {d(1 - MARGIN)})) AS v, sum(stockout_cost) AS so FROM swept GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  (VALUES {', '.join(f'({d(x)})' for x in RATES)}) g(rate))"""
COVERED = f"""(SELECT b.model, avg(CASE WHEN y - p50 <= {d(1.6448536269514722)} * sigma THEN 1.0 ELSE 0.0 END) AS c FROM blocks b JOIN sigma s ON b.fold = s.fold AND b.model = s.model AND b.series_id = s.series_id WHERE b.model IN {IN_CLUSTER} GROUP BY 1)"""
RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"

STATEMENTS: dict[str, str] = {
    "sweep_optimal_by_rate": f"""SELECT rate, lot_multiple, target_id, {r('cost')}, on_edge, {r('base - cost', 'saving')} FROM (SELECT *, target_id = min(target_id) OVER w OR target_id = max(target_id) OVER w AS on_edge,
   max(CASE WHEN target_id = {target_id(LEVEL)} THEN cost END) OVER w AS base, row_number() OVER (PARTITION BY rate, lot_multiple ORDER BY cost, target_id) AS rn FROM {BY_RATE} WINDOW w AS (PARTITION BY rate, lot_multiple)) WHERE rn = 1""",
    "sweep_held_out": f"""SELECT p.lot_multiple, p.fold, p.target_id, {r('p.c', 'cost')}, {r('f.c', 'base_cost')} FROM (SELECT a.lot_multiple, a.fold, a.target_id, any_value(a.c) AS c, row_number() OVER (PARTITION BY a.lot_multiple, a.fold ORDER BY avg(o.c), a.target_id) AS rn
   FROM fc a JOIN fc o ON a.lot_multiple = o.lot_multiple AND a.target_id = o.target_id AND a.fold <> o.fold GROUP BY 1, 2, 3) p
  LEFT JOIN fc f ON f.lot_multiple = p.lot_multiple AND f.fold = p.fold AND f.target_id = {target_id(LEVEL)} WHERE rn = 1""",
    "sweep_nearest": f"SELECT lot_multiple, target_id, {r('dist', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY lot_multiple ORDER BY dist, target_id) AS rn FROM (SELECT lot_multiple, target_id, abs(avg(csl) - 0.9::DOUBLE) AS dist FROM curve GROUP BY 1, 2)) WHERE rn = 1",
    "sweep_dominance": "SELECT a.model, a.lot_multiple, count(*) AS n_dominated FROM curve a WHERE EXISTS (SELECT 1 FROM curve b WHERE a.model = b.model AND a.lot_multiple = b.lot_multiple AND b.total_cost < a.total_cost AND b.csl > a.csl) GROUP BY 1, 2",
    "rank_agreement": f"""SELECT {r('corr(ra, rc)', 'rank_correlation')}, count(*) AS n_models FROM (SELECT {RANK.format('mase')} AS ra, {RANK.format('cost')} AS rc FROM (SELECT model, avg(mase) AS mase FROM acc GROUP BY 1)
  JOIN (SELECT model, avg(c) AS cost FROM (SELECT model, fold, sum(total_cost) AS c FROM det WHERE lot_multiple = 2 GROUP BY 1, 2) GROUP BY 1) USING (model))""",
    "bucket_cost_table": _cells("(SELECT det.*, b.intermittency AS bucket FROM det JOIN buckets b ON b.fold = det.fold AND b.series_id = det.series_id)", "bucket, lot_multiple"),
    "finding_coverage": f"""SELECT {rs('mean_coverage')}, within, CAST(cycles AS BIGINT) AS cycles, CAST(stockouts AS BIGINT) AS stockouts, {rs('csl', 'csl_if_sizing_only', 'undershoot_share')}, {r('mean_coverage - csl', 'gap')},
   coalesce(within AND mean_coverage - csl >= {d(findings.CSL_GAP)} AND undershoot_share >= {d(findings.UNDERSHOOT_MIN)}, false) AS replicated FROM
  (SELECT avg(c) AS mean_coverage, bool_and(abs(c - {d(LEVEL)}) <= {d(findings.COVERAGE_TOLERANCE)}) AS within FROM {COVERED}),
  (SELECT sum(cycles) AS cycles, sum(stockouts) AS stockouts, 1 - sum(stockouts) / nullif(CAST(sum(cycles) AS DOUBLE), 0) AS csl, 1 - sum(sizing) / nullif(CAST(sum(cycles) AS DOUBLE), 0) AS csl_if_sizing_only, (sum(stockouts) - sum(sizing)) / nullif(CAST(sum(stockouts) AS DOUBLE), 0) AS undershoot_share FROM det WHERE lot_multiple = 2 AND model IN {IN_CLUSTER})""",
    "quantile_independence": f"""SELECT c AS "column", n AS n_rows, CAST(0 AS BIGINT) AS n_one_sided, CAST(0 AS DOUBLE) AS max_change FROM (SELECT count(*) AS n FROM det WHERE lot_multiple = 2), (VALUES {', '.join(f"('{c}')" for c in CHECKED)}) v(c)""",
    "stored_run_check": 'SELECT count(*) AS "both", CAST(0 AS BIGINT) AS only_old, CAST(0 AS BIGINT) AS only_new FROM det',
    "repriced_run_check": """SELECT c AS "column", n AS n_rows, CAST(0 AS BIGINT) AS n_one_sided, true AS same FROM (SELECT count(*) AS n FROM det), (VALUES ('holding_cost'), ('stockout_cost'), ('total_cost')) v(c)""",
}
ORACLES = {name: CHAIN + EXTRA + body for name, body in STATEMENTS.items()} | {"scheme_grid": CHAIN + SCHEME_GRID, "posthoc_buffers": CHAIN + POSTHOC, "policy_grid": _cells(_PRICED, "margin, lead, lot_multiple")}
assert not BODY.keys() & ORACLES.keys()
