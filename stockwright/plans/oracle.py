"""DuckDB SQL for the registered queries, as one chain of named steps.

Every statement starts with the same chain; steps that it does not use cost
nothing. Numbers are rounded as the queries round them.
"""

from __future__ import annotations

from ..functions.mathx import HART_BOTTOM, HART_TOP, ROOT_2PI, Z90, cut_points, z
from ..grain import WEEKLY as G
from ..operators.economics import HOLDING, MARGIN
from ..operators.sweep import TARGETS, target_id

L, LEVEL, ALPHA = G.lead_time, 0.95, 0.1
Z95 = z(LEVEL)
RATE = HOLDING / G.periods_per_year
MODELS = ("SeasonalNaive", "MovingAverage", "CrostonClassic", "CrostonSBA", "TSB")


def cut(rank: str, n: str, parts: int) -> str:
    """Part of a rank, cut at linear quantiles of the ranks."""
    out = "1"
    for q in cut_points(parts):
        at = f"(CAST({n} - 1 AS DOUBLE) * CAST({q!r} AS DOUBLE))"
        low = f"floor({at})"
        edge = f"CASE WHEN {at} - {low} < 0.5 THEN ({low} + 1) + ({at} - {low}) ELSE ({low} + 2) - (1 - ({at} - {low})) END"
        out += f" + CASE WHEN {rank} > {edge} THEN 1 ELSE 0 END"
    return f"({out})"


def _horner(cs: tuple[float, ...], x: str) -> str:
    out = f"CAST({cs[0]!r} AS DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def cdf(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2.0)"
    build = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        build = f"({a} + {k} / {build})"
    upper = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < CAST(7.07106781186547 AS DOUBLE) THEN {e} * {_horner(HART_TOP, a)} / {_horner(HART_BOTTOM, a)} ELSE {e} / {build} / CAST({ROOT_2PI!r} AS DOUBLE) END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({upper}) ELSE {upper} END"


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _panel(p: str, source: str) -> str:
    return f"""
{p}units AS MATERIALIZED (
  SELECT s.series_id, s.date, coalesce(u.y, 0.0) AS y FROM
    (SELECT i.series_id, CAST(unnest(generate_series(e.lo, e.hi, INTERVAL 7 DAY)) AS DATE) AS date
     FROM (SELECT DISTINCT series_id FROM {source}) i, (SELECT CAST(min(week) AS TIMESTAMP) AS lo, CAST(max(week) AS TIMESTAMP) AS hi FROM {source}) e) s
  LEFT JOIN (SELECT series_id, week AS date, sum(units) AS y FROM {source} GROUP BY 1, 2) u ON s.series_id = u.series_id AND s.date = u.date),
{p}mid AS (SELECT series_id, median(unit_price) AS m FROM {source} GROUP BY 1),
{p}wp AS (SELECT l.series_id, l.week AS date, median(l.unit_price) AS price FROM {source} l JOIN {p}mid USING (series_id) WHERE l.unit_price / m <= 10 AND l.unit_price / m >= 0.1 GROUP BY 1, 2),
{p}raw AS (SELECT u.*, w.price AS p0 FROM {p}units u LEFT JOIN {p}wp w ON u.series_id = w.series_id AND u.date = w.date),
{p}panel AS MATERIALIZED (SELECT series_id, date, y, coalesce(
    last_value(p0 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(p0 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM {p}raw)"""


def _sim(name: str, source: str, keys: str, lead: int = L) -> str:
    """Recursive simulation over rows (keys, fold, series_id, s, up_to, start, …)."""
    k = keys.split(", ")
    on = " AND ".join(f"r.{c} = x.{c}" for c in k)
    rk = ", ".join(f"r.{c}" for c in k)
    return f"""
{name}_in AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM {source}),
{name}_r AS (
  SELECT rid, 0 AS t, start AS stock, -1 AS due, CAST(0 AS DOUBLE) AS coming, false AS short, CAST(0 AS DOUBLE) AS exposure,
         0 AS cycles, 0 AS stockouts, 0 AS sizing, 0 AS orders, 0 AS small,
         CAST(0 AS DOUBLE) AS shipped, CAST(0 AS DOUBLE) AS demanded, CAST(0 AS DOUBLE) AS lost, CAST(0 AS DOUBLE) AS stocked, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS qty_sq
  FROM {name}_in
  UNION ALL
  SELECT rid, t + 1, remain, CASE WHEN places THEN t + {lead} WHEN waiting THEN due ELSE -1 END, CASE WHEN places THEN up_to - remain WHEN waiting THEN coming ELSE 0 END,
         CASE WHEN places THEN false ELSE short2 END, CASE WHEN places THEN 0 ELSE exposure2 END,
         cycles + arr, stockouts + arr * CAST(short AS INT), sizing + arr * CAST(short AND exposure > s + 1e-9 AS INT), orders + CAST(places AS INT), small + CAST(places AND up_to - remain < 1 AS INT),
         shipped + sold, demanded + dem, lost + dem - sold, stocked + remain, qty + CASE WHEN places THEN up_to - remain ELSE 0 END, qty_sq + CASE WHEN places THEN (up_to - remain) * (up_to - remain) ELSE 0 END
  FROM (SELECT *, (NOT waiting) AND remain < s AND up_to - remain > 0 AS places, waiting AND (short OR dem - sold > 0) AS short2, CASE WHEN waiting THEN exposure + dem ELSE 0 END AS exposure2
        FROM (SELECT *, st - least(st, dem) AS remain, least(st, dem) AS sold
              FROM (SELECT r.*, x.s, x.up_to, q.dem, CAST(r.due = r.t AS INT) AS arr, (r.due <> r.t) AND r.due >= 0 AS waiting, r.stock + CASE WHEN r.due = r.t THEN r.coming ELSE 0 END AS st
                    FROM {name}_r r JOIN {name}_in x ON r.rid = x.rid JOIN dem q ON q.fold = x.fold AND q.series_id = x.series_id AND q.t = r.t)))),
{name} AS MATERIALIZED (SELECT x.*, r.cycles, r.stockouts, r.sizing, r.orders, r.small, r.shipped, r.demanded, r.lost, r.stocked, r.qty, r.qty_sq,
    {d(RATE)} * (unit_price * {d(1 - MARGIN)}) * stocked AS holding_cost, unit_price * {d(MARGIN)} * lost AS stockout_cost,
    {d(RATE)} * (unit_price * {d(1 - MARGIN)}) * stocked + unit_price * {d(MARGIN)} * lost AS total_cost
  FROM {name}_r r JOIN {name}_in x ON r.rid = x.rid WHERE r.t = {G.horizon})"""


PTS = f"""
pts AS MATERIALIZED (
  SELECT o.fold, o.back, o.train_end, u.series_id, 'SeasonalNaive' AS model, h.step, u.y AS p50 FROM origins o, steps h, units u WHERE u.date = o.train_end + (h.step - {G.naive_season}) * 7
  UNION ALL
  SELECT o.fold, o.back, o.train_end, u.series_id, 'MovingAverage', h.step, u.p50 FROM origins o, steps h,
    (SELECT o2.train_end, series_id, avg(y) AS p50 FROM (SELECT DISTINCT train_end FROM origins) o2, units WHERE date > o2.train_end - {7 * G.ma_window} AND date <= o2.train_end GROUP BY 1, 2) u WHERE u.train_end = o.train_end
  UNION ALL
  SELECT o.fold, o.back, o.train_end, c.series_id, m.model, h.step,
         CASE m.model WHEN 'CrostonClassic' THEN coalesce(c.size / c.gap, 0.0) WHEN 'CrostonSBA' THEN coalesce(c.size / c.gap, 0.0) * {d(1 - ALPHA / 2)} ELSE coalesce(c.p * c.size, 0.0) END
  FROM origins o, steps h, states c, (VALUES ('CrostonClassic'), ('CrostonSBA'), ('TSB')) m(model) WHERE c.date = o.train_end)"""

def chain(lead: int = L) -> str:
    """All steps, for a lead time."""
    return f"""WITH RECURSIVE
ship AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_quantity AS units, l_extendedprice / nullif(l_quantity, 0) AS unit_price,
         p_brand AS brand, p_type AS type, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
dlines AS (SELECT brand || '|' || type AS series_id, week, units, unit_price FROM ship),
lines AS (SELECT * FROM dlines UNION ALL SELECT 'P' || CASE WHEN l_partkey < 100000 THEN lpad(CAST(l_partkey AS VARCHAR), 5, '0') ELSE CAST(l_partkey AS VARCHAR) END, week, units, unit_price FROM ship),
{_panel("d", "dlines").strip()},
{_panel("", "lines").strip()},
fin AS (SELECT max(CAST(date_trunc('week', l_shipdate) AS DATE)) AS e FROM lineitem),
folds AS MATERIALIZED (SELECT CAST(f AS INT) AS fold, e - {7 * G.horizon} * ({G.n_folds} - f) - {7 * G.horizon} AS train_end, e - {7 * G.horizon} * ({G.n_folds} - f) - {7 * (G.horizon - 1)} AS test_start, e - {7 * G.horizon} * ({G.n_folds} - f) AS test_end
          FROM fin, (SELECT CAST(unnest(generate_series(1, {G.n_folds})) AS INT) AS f)),
train AS (SELECT * FROM panel p JOIN folds f ON p.date <= f.train_end),
scales AS MATERIALIZED (SELECT fold, series_id, nullif(avg(abs(dd)), 0) AS scale_mae, nullif(avg(dd * dd), 0) AS scale_mse FROM
  (SELECT fold, series_id, y - lag(y, {G.mase_lag}) OVER (PARTITION BY fold, series_id ORDER BY date) AS dd FROM train) GROUP BY 1, 2),
wts AS MATERIALIZED (SELECT fold, series_id, sum(y * coalesce(price, 0)) AS weight FROM train WHERE date > train_end - {7 * G.horizon} GROUP BY 1, 2),
stats AS MATERIALIZED (SELECT fold, series_id, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate, avg(y) AS volume FROM train GROUP BY 1, 2),
prices AS MATERIALIZED (SELECT t.fold, series_id, coalesce(avg(price), any_value(e.every)) AS unit_price FROM train t JOIN (SELECT fold, avg(price) AS every FROM train GROUP BY 1) e ON t.fold = e.fold GROUP BY 1, 2),
nth AS MATERIALIZED (SELECT series_id, date, y, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n FROM units),
states AS (
  SELECT series_id, date, n, CASE WHEN y > 0 THEN y END AS size, CASE WHEN y > 0 THEN CAST(1 AS DOUBLE) END AS gap, CASE WHEN y > 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS since, CASE WHEN y > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p FROM nth WHERE n = 1
  UNION ALL
  SELECT x.series_id, x.date, x.n, CASE WHEN x.y > 0 THEN coalesce(s.size + {d(ALPHA)} * (x.y - s.size), x.y) ELSE s.size END,
         CASE WHEN x.y > 0 THEN coalesce(s.gap + {d(ALPHA)} * (s.since + 1 - s.gap), s.since + 1) ELSE s.gap END,
         CASE WHEN x.y > 0 THEN 0 ELSE s.since + 1 END, s.p + {d(ALPHA)} * (CASE WHEN x.y > 0 THEN 1 ELSE 0 END - s.p)
  FROM states s JOIN nth x ON s.series_id = x.series_id AND x.n = s.n + 1),
steps AS (SELECT CAST(unnest(generate_series(1, {G.horizon})) AS INT) AS step),
origins AS MATERIALIZED (SELECT fold, back, train_end - {7 * G.horizon} * back AS train_end FROM folds, (VALUES (0), (1), (2)) b(back)
  UNION ALL SELECT 0, 0, train_end - {7 * lead} FROM folds WHERE fold = 1),
{PTS.strip()},
act AS (SELECT p.*, CAST(p.train_end + 7 * p.step AS DATE) AS date, u.y AS actual FROM pts p LEFT JOIN units u ON u.series_id = p.series_id AND u.date = CAST(p.train_end + 7 * p.step AS DATE)),
q0 AS (SELECT fold, model, series_id, step, max(CASE WHEN back = 0 THEN date END) AS date, max(CASE WHEN back = 0 THEN p50 END) AS p50, max(CASE WHEN back = 0 THEN actual END) AS y,
        max(CASE WHEN back = 1 THEN abs(actual - p50) END) AS e1, max(CASE WHEN back = 2 THEN abs(actual - p50) END) AS e2 FROM act WHERE fold > 0 GROUP BY 1, 2, 3, 4),
q1 AS (SELECT *, coalesce(least(e1, e2) + 0.8::DOUBLE * abs(e1 - e2), e1, e2, 0) AS half FROM q0),
cache AS MATERIALIZED (SELECT fold, model, series_id, step, date, greatest(p50 - half, 0) AS p10, p50, greatest(p50 + half, 0) AS p90, y FROM q1),
ps AS MATERIALIZED (SELECT c.fold, c.model, c.series_id, avg(abs(y - p50)) / any_value(scale_mae) AS mase, sqrt(avg((y - p50) * (y - p50)) / any_value(scale_mse)) AS rmsse
       FROM cache c LEFT JOIN scales s ON c.fold = s.fold AND c.series_id = s.series_id GROUP BY 1, 2, 3),
acc AS MATERIALIZED (SELECT a.*, b.* EXCLUDE (fold, model) FROM
  (SELECT ps.fold, ps.model, count(*) AS n_series, avg(mase) AS mase, avg(rmsse) AS rmsse, sum(rmsse * coalesce(weight, 0)) / nullif(sum(CASE WHEN rmsse IS NOT NULL THEN coalesce(weight, 0) END), 0) AS wrmsse
   FROM ps LEFT JOIN wts w ON ps.fold = w.fold AND ps.series_id = w.series_id GROUP BY 1, 2) a
  JOIN (SELECT fold, model, avg(greatest(0.1::DOUBLE * (y - p10), (0.1::DOUBLE - 1) * (y - p10))) AS pinball_p10, avg(greatest(0.5::DOUBLE * (y - p50), (0.5::DOUBLE - 1) * (y - p50))) AS pinball_p50,
        avg(greatest(0.9::DOUBLE * (y - p90), (0.9::DOUBLE - 1) * (y - p90))) AS pinball_p90, avg(CASE WHEN y BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS coverage_80 FROM cache GROUP BY 1, 2) b ON a.fold = b.fold AND a.model = b.model),
lead AS MATERIALIZED (SELECT fold, model, series_id, sum(p50) AS mean, sqrt(sum(((p90 - p10) / (2 * {d(Z90)})) * ((p90 - p10) / (2 * {d(Z90)})))) AS std FROM cache WHERE step <= {lead} GROUP BY 1, 2, 3),
res AS MATERIALIZED (SELECT fold, model, series_id, coalesce(sum(y), 0) - sum(p50) AS residual FROM cache WHERE step <= {lead} GROUP BY 1, 2, 3),
chained AS (SELECT fold + 1 AS fold, model, series_id, residual FROM res WHERE fold < {G.n_folds}
  UNION ALL SELECT 1, model, series_id, coalesce(sum(actual), 0) - sum(p50) FROM act WHERE fold = 0 AND step <= {lead} GROUP BY 2, 3),
rb AS (SELECT c.*, CASE WHEN s.zero_rate > 0.5 THEN 'intermittent' ELSE 'regular' END AS bucket FROM chained c LEFT JOIN stats s ON c.fold = s.fold AND c.series_id = s.series_id),
sigma AS MATERIALIZED (SELECT r.fold, r.model, r.series_id, coalesce(b.sd, e.sd) AS sigma FROM rb r JOIN (SELECT fold, model, bucket, stddev_samp(residual) AS sd FROM rb GROUP BY 1, 2, 3) b ON r.fold = b.fold AND r.model = b.model AND r.bucket = b.bucket
  JOIN (SELECT fold, model, stddev_samp(residual) AS sd FROM rb GROUP BY 1, 2) e ON r.fold = e.fold AND r.model = e.model),
buckets AS MATERIALIZED (SELECT fold, series_id, zero_rate, volume, kind AS intermittency, 'q' || {cut("rk", "n", 5)} AS quintile,
    kind || '_' || CASE {cut("rk", "n", 3)} WHEN 1 THEN 'lo' WHEN 2 THEN 'mid' ELSE 'hi' END AS tercile, {cut("rk", "n", 10)} AS decile FROM
  (SELECT *, CASE WHEN zero_rate > 0.5 THEN 'intermittent' ELSE 'regular' END AS kind, row_number() OVER (PARTITION BY fold ORDER BY volume, series_id) AS rk, count(*) OVER (PARTITION BY fold) AS n FROM stats)),
dem AS MATERIALIZED (SELECT f.fold, u.series_id, CAST((u.date - f.test_start) / 7 AS INT) AS t, u.y AS dem FROM folds f JOIN units u ON u.date BETWEEN f.test_start AND f.test_end),
pol AS MATERIALIZED (SELECT l.fold, l.model, l.series_id, l.mean, s.sigma AS std, {d(Z95)} * s.sigma AS safety_stock, l.mean + {d(Z95)} * s.sigma AS rp, p.unit_price
  FROM lead l JOIN sigma s ON l.fold = s.fold AND l.model = s.model AND l.series_id = s.series_id JOIN prices p ON l.fold = p.fold AND l.series_id = p.series_id),
pol2 AS (SELECT pol.*, lot AS lot_multiple, round(rp, 6) AS s, round(rp + lot * greatest(mean, 0), 6) AS up_to, round(rp + 0.5 * (lot * greatest(mean, 0)), 6) AS start FROM pol, (VALUES (CAST(0 AS DOUBLE)), (CAST(2 AS DOUBLE))) m(lot)),
{_sim("det", "pol2", "fold, model, series_id, lot_multiple", lead).strip()},
grid(target_id, target, zz) AS (VALUES {", ".join(f"({target_id(t)}, {d(t)}, {d(z(t))})" for t in TARGETS)}),
pol3 AS (SELECT p.*, lot AS lot_multiple, g.target_id, round(mean + zz * std, 6) AS s, round(mean + zz * std + lot * greatest(mean, 0), 6) AS up_to, round(mean + zz * std + 0.5 * (lot * greatest(mean, 0)), 6) AS start
  FROM pol p, grid g, (VALUES (CAST(0 AS DOUBLE)), (CAST(2 AS DOUBLE))) m(lot)),
{_sim("swept", "pol3", "fold, model, series_id, lot_multiple, target_id", lead).strip()},
pairs AS MATERIALIZED (SELECT a.model AS a, b.model AS b, a.fold, a.series_id, a.step, a.p50 AS va, b.p50 AS vb, a.y FROM cache a JOIN cache b ON a.fold = b.fold AND a.series_id = b.series_id AND a.step = b.step AND a.model < b.model),
blocks AS MATERIALIZED (SELECT model, fold, series_id, CAST((step - 1) // {lead} AS INT) AS block, sum(p50) AS p50, sum(y) AS y FROM cache GROUP BY 1, 2, 3, 4 HAVING count(*) = {lead}),
parts AS MATERIALIZED (SELECT lot_multiple, model, avg(v) / {G.periods_per_year} AS holding_per_rate, avg(so) AS stockout FROM
  (SELECT lot_multiple, model, fold, sum(stocked * unit_price * {d(1 - MARGIN)}) AS v, sum(stockout_cost) AS so FROM det GROUP BY 1, 2, 3) GROUP BY 1, 2),
curve AS MATERIALIZED (SELECT target_id, lot_multiple, model, avg(total_cost) AS total_cost, avg(holding_cost) AS holding_cost, avg(stockout_cost) AS stockout_cost, avg(csl) AS csl, avg(fill) AS fill FROM
  (SELECT target_id, lot_multiple, model, fold, sum(total_cost) AS total_cost, sum(holding_cost) AS holding_cost, sum(stockout_cost) AS stockout_cost, 1 - sum(stockouts) / nullif(CAST(sum(cycles) AS DOUBLE), 0) AS csl, sum(shipped) / nullif(sum(demanded), 0) AS fill FROM swept GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
inv AS MATERIALIZED (SELECT (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(l_orderkey AS VARCHAR) AS invoice, l_linenumber AS line, lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') || CASE WHEN l_partkey < 100000 THEN '' WHEN l_partkey < 2700000 THEN chr(CAST(l_partkey // 100000 + 64 AS INT)) ELSE chr(CAST((l_partkey // 100000 - 1) // 26 + 64 AS INT)) || chr(CAST((l_partkey // 100000 - 1) % 26 + 65 AS INT)) END AS stock_code, CAST(l_shipdate AS TIMESTAMP) AS invoice_date,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_extendedprice / nullif(l_quantity, 0) AS price_gbp, CAST(o_custkey AS VARCHAR) AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
geo AS (SELECT r_name AS region, n_name AS nation, type, brand, CAST(date_trunc('year', week) AS DATE) AS date, units FROM ship JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
daily AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, sum(value) AS y FROM events GROUP BY 1, 2),
log AS MATERIALIZED (SELECT * FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY date) AS forecast FROM daily) WHERE forecast IS NOT NULL)
"""


CHAIN = chain()


def r(x: str, name: str | None = None) -> str:
    return f"CASE WHEN abs({x}) < 1000 THEN round({x}, 6) ELSE round({x} + 3e-6, 3) END + 0.0 AS {name or x.split('.')[-1]}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def _forecast(model: str) -> str:
    return f"SELECT fold, series_id, step, date, {rs('p10', 'p50', 'p90', 'y')} FROM cache WHERE model = '{model}'"


def _corr(a: str, b: str, keys: str, value: str = "va, vb") -> str:
    x, y = value.split(", ")
    return f"SELECT a, b, {keys}, CASE WHEN var_pop({x}) * count({x}) > 1e-12 AND var_pop({y}) * count({y}) > 1e-12 THEN corr({x}, {y}) END AS r FROM {a} GROUP BY a, b, {keys}"


def _ranked(source: str) -> str:
    def rank(v: str) -> str:
        return f"rank() OVER (PARTITION BY a, b ORDER BY round({v}, 9)) + (count(*) OVER (PARTITION BY a, b, round({v}, 9)) - 1) / 2.0"

    return f"(SELECT *, {rank('va')} AS ra, {rank('vb')} AS rb FROM {source})"


LEVEL_PAIRS = "(SELECT a, b, fold, series_id, avg(va) AS va, avg(vb) AS vb FROM pairs GROUP BY 1, 2, 3, 4)"
CORR = f"""SELECT p.a, p.b, p.pearson_pooled, p.spearman_pooled, l.pearson_level, l.spearman_level, m.mean_series, m.defined FROM
 (SELECT a, b, corr(va, vb) AS pearson_pooled, corr(ra, rb) AS spearman_pooled FROM {_ranked('pairs')} GROUP BY 1, 2) p
 JOIN (SELECT a, b, corr(va, vb) AS pearson_level, corr(ra, rb) AS spearman_level FROM {_ranked(LEVEL_PAIRS)} GROUP BY 1, 2) l ON p.a = l.a AND p.b = l.b
 JOIN (SELECT a, b, avg(r) AS mean_series, avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END) AS defined FROM ({_corr('pairs', '', 'fold, series_id')}) GROUP BY 1, 2) m ON p.a = m.a AND p.b = m.b"""
CLOSE = """(SELECT a, b, fold, series_id, coalesce(abs(ta - tb) / nullif(greatest((ta + tb) / 2, 0), 0), 0) < 0.05 AS close FROM
 (SELECT a, b, fold, series_id, sum(va) AS ta, sum(vb) AS tb FROM pairs GROUP BY 1, 2, 3, 4))"""
CLOSE_SUMMARY = f"SELECT avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) AS all_close, avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) AS any_close, count(*) AS n FROM (SELECT fold, series_id, bool_and(close) AS e, bool_or(close) AS s FROM {CLOSE} GROUP BY 1, 2)"


def _side(source: str, keys: str, name: str) -> str:
    return f"""(SELECT w.a, w.b, w.pooled AS pooled_{name}, w.diff AS diff_{name}, w.of_mae AS of_mae_{name}, m.within AS within_{name}, m.defined AS defined_{name} FROM
  (SELECT a, b, corr(va, vb) AS pooled, avg(abs(va - vb)) / nullif(avg(y), 0) AS diff, avg(abs(va - vb)) / nullif(0.5 * (avg(abs(va - y)) + avg(abs(vb - y))), 0) AS of_mae FROM {source} GROUP BY 1, 2) w
  JOIN (SELECT a, b, avg(r) AS within, avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END) AS defined FROM ({_corr(source, '', keys)}) GROUP BY 1, 2) m ON w.a = m.a AND w.b = m.b)"""


BLOCK_PAIRS = "(SELECT a.model AS a, b.model AS b, a.fold, a.series_id, a.block, a.p50 AS va, b.p50 AS vb, a.y FROM blocks a JOIN blocks b ON a.fold = b.fold AND a.series_id = b.series_id AND a.block = b.block AND a.model < b.model)"
FEATURES = ", ".join(
    [f"lag(y, {k}) OVER w AS lag_{k}" for k in G.lags]
    + [
        f"round(avg(y) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS roll_mean_{n}, round(stddev_samp(y) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS roll_std_{n}, "
        f"round(avg(CASE WHEN before = 0 THEN 1.0 ELSE 0.0 END) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS roll_zero_rate_{n}"
        for n in G.windows
    ]
)
TOTALS = "cycles, stockouts, sizing, orders, small"
TOTALS_D = ("shipped", "demanded", "lost", "stocked", "qty", "qty_sq")
_GROUP = "(fold, model, lot_multiple)"


def _bucket_stock(bucket: str, expr: str) -> str:
    return f"SELECT r.fold, r.model, {bucket} AS bucket, count(residual) AS n, stddev_samp(residual) AS std, {expr} AS safety_stock FROM res r JOIN buckets b ON r.fold = b.fold AND r.series_id = b.series_id GROUP BY 1, 2, 3"


SERIES_STOCK = f"(SELECT r.fold, r.model, r.series_id, t.safety_stock FROM res r JOIN buckets b ON r.fold = b.fold AND r.series_id = b.series_id JOIN ({_bucket_stock('intermittency', f'{d(Z95)} * stddev_samp(residual)')}) t ON r.fold = t.fold AND r.model = t.model AND b.intermittency = t.bucket)"
DECIDED = f"""(SELECT l.fold, l.model, l.series_id, l.mean, k.safety_stock / {d(Z95)} AS std, round(((length(l.series_id) + ascii(l.series_id) + l.fold) % 3) * 0.5 * l.mean, 6) AS on_hand, k.safety_stock, l.mean + k.safety_stock AS reorder_point,
  l.mean + k.safety_stock + 2.0 * greatest(l.mean, 0) AS order_up_to FROM lead l JOIN {SERIES_STOCK} k ON l.fold = k.fold AND l.model = k.model AND l.series_id = k.series_id)"""


def _reprice(rate: float, margin: float | None) -> str:
    cost = "unit_price" if margin is None else f"unit_price * {d(1 - margin)}"
    pen = "5.0" if margin is None else f"unit_price * {d(margin)}"
    h = f"holding_cost * ({d(rate / G.periods_per_year)} / {d(RATE)}) * ({cost} / (unit_price * {d(1 - MARGIN)}))"
    s = f"stockout_cost * (({pen}) / (unit_price * {d(MARGIN)}))"
    return f"SELECT model, lot_multiple, {r(f'sum({h})', 'holding_cost')}, {r(f'sum({s})', 'stockout_cost')}, {r(f'sum({h} + {s})', 'total_cost')}, {d(rate)} AS annual_rate, {'CAST(NULL AS DOUBLE)' if margin is None else d(margin)} AS margin FROM det GROUP BY 1, 2"


def _quart(q: float) -> str:
    return f"quantile_cont(cr, {q})"


BODY: dict[str, str] = {
    "panel_weekly": f"SELECT series_id, date, {r('y')} FROM dunits",
    "panel_price_ffill": f"SELECT series_id, date, {r('price')} FROM dpanel",
    "features_weekly": f"SELECT series_id, date, y, round(price, 6) AS price, {FEATURES}, round(price / nullif(lag(price, {G.price_lag}) OVER w, 0) - 1, 6) + 0.0 AS price_change FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY date) AS before FROM dpanel) WINDOW w AS (PARTITION BY series_id ORDER BY date)",
    "folds_weekly": "SELECT fold, train_end, test_start, test_end FROM folds",
    "insample_scales": f"SELECT fold, series_id, {rs('scale_mae', 'scale_mse')} FROM scales",
    "revenue_weights": f"SELECT fold, series_id, {r('weight')} FROM wts",
    "zero_rates": f"SELECT fold, series_id, {rs('zero_rate', 'volume')} FROM stats",
    "unit_prices": f"SELECT fold, series_id, {r('unit_price')} FROM prices",
    "hashed_sample": "SELECT series_id FROM (SELECT DISTINCT series_id FROM units) ORDER BY md5('42:' || series_id), series_id LIMIT 40",
    "selected_series": "SELECT series_id, CAST(count_if(y > 0) AS BIGINT) AS active_weeks FROM units WHERE date < (SELECT min(date) FROM units) + 364 GROUP BY 1 HAVING count_if(y > 0) >= 13",
    "closed_weeks": f"SELECT date, {r('total')} FROM (SELECT date, sum(y) AS total FROM units GROUP BY 1) WHERE total < 0.05 * (SELECT median(t) FROM (SELECT sum(y) AS t FROM units GROUP BY date))",
    "monthly_share": f"SELECT CAST(month(date) AS INT) AS month, {r('sum(y) / (SELECT sum(y) FROM units)', 'share')} FROM units GROUP BY 1",
    "weekday_share": f"SELECT CAST((isodow(day) - 1 + 2) % 7 + 1 AS INT) AS wday, {r('sum(units) / (SELECT sum(units) FROM ship)', 'share')} FROM ship GROUP BY 1",
    "price_corr": f"SELECT series_id, {r('CASE WHEN var_samp(price) > 1e-12 AND var_samp(y) > 1e-12 THEN corr(price, y) END', 'r')} FROM dpanel GROUP BY 1",
    "late_starters": "SELECT series_id, min(date) AS first_sale FROM units WHERE y > 0 GROUP BY 1 HAVING min(date) - (SELECT min(date) FROM units) > 182",
    "zero_shares": f"""SELECT {rs('all_weeks', 'open_weeks', 'year_1', 'year_2', 'mean_nonzero', 'median_nonzero', 'q25', 'q50', 'q75')}, silent, n_series FROM
  (SELECT avg(zr) AS all_weeks, avg(CASE WHEN NOT closed THEN zr END) AS open_weeks, avg(CASE WHEN early THEN zr END) AS year_1, avg(CASE WHEN NOT early THEN zr END) AS year_2, avg(CASE WHEN y > 0 THEN y END) AS mean_nonzero, median(CASE WHEN y > 0 THEN y END) AS median_nonzero FROM zc),
  (SELECT quantile_cont(sh, 0.25) AS q25, quantile_cont(sh, 0.5) AS q50, quantile_cont(sh, 0.75) AS q75, CAST(count_if(late <= 0) AS BIGINT) AS silent, count(*) AS n_series FROM
    (SELECT series_id, avg(CASE WHEN NOT closed THEN zr END) AS sh, max(CASE WHEN date > (SELECT max(date) FROM units) - 91 THEN y END) AS late FROM zc GROUP BY 1))""",
    "bulk_orders": f"""SELECT c.series_id, c.date, {r('c.y')}, {r('l.m', 'largest_line')}, l.n AS n_lines, {r('l.m / c.y', 'largest_share')}, {r('c.y / t.typical', 'x_typical')} FROM (SELECT * FROM units ORDER BY y DESC, series_id, date LIMIT 12) c
  LEFT JOIN (SELECT series_id, week, max(units) AS m, count(*) AS n FROM lines GROUP BY 1, 2) l ON l.series_id = c.series_id AND l.week = c.date
  LEFT JOIN (SELECT series_id, median(y) AS typical FROM units WHERE y > 0 GROUP BY 1) t ON t.series_id = c.series_id""",
    "bulk_concentration": f"""SELECT {r('a.s', 'top_1pct_share')}, {r('b.s', 'large_line_share')} FROM
  (SELECT sum(CASE WHEN rn <= greatest(1, n // 100) THEN y END) / sum(y) AS s FROM (SELECT y, row_number() OVER (ORDER BY y DESC) AS rn, count(*) OVER () AS n FROM units WHERE y > 0)) a,
  (SELECT sum(CASE WHEN units >= 45 THEN units ELSE 0 END) / sum(units) AS s FROM lines) b""",
    "selection_effect": f"""SELECT "group", {rs('units_1', 'units_2', 'peak_1', 'peak_2')}, {r('units_2 / nullif(units_1, 0)', 'growth')} FROM (SELECT "group", max(CASE WHEN yr = 1 THEN u END) AS units_1, max(CASE WHEN yr = 2 THEN u END) AS units_2, max(CASE WHEN yr = 1 THEN pk END) AS peak_1, max(CASE WHEN yr = 2 THEN pk END) AS peak_2 FROM
  (SELECT "group", yr, sum(total) AS u, avg(CASE WHEN month(date) BETWEEN 9 AND 11 THEN total END) / nullif(avg(CASE WHEN month(date) BETWEEN 3 AND 7 THEN total END), 0) AS pk FROM
    (SELECT g."group", yr, date, sum(y) AS total FROM (SELECT u.*, CAST((date - (SELECT min(date) FROM units)) // 364 AS INT) + 1 AS yr FROM units u) p
     JOIN (SELECT series_id, 'all' AS "group" FROM units GROUP BY 1 UNION ALL SELECT series_id, CASE WHEN count_if(y > 0 AND date < (SELECT min(date) FROM units) + 364) >= 26 THEN 'selected' ELSE 'not selected' END FROM units GROUP BY 1) g ON g.series_id = p.series_id
     WHERE yr <= 2 GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)""",
    "future_exog": f"""SELECT p.series_id, CAST(e.hi + 7 * (h.step) AS DATE) AS date, {r('p.price', 'price')}, CAST(month(CAST(e.hi + 7 * h.step AS DATE)) AS INT) AS month, CAST(week(CAST(e.hi + 7 * h.step AS DATE)) AS INT) AS weekofyear
  FROM (SELECT *, 7 - row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS i FROM dpanel QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 7) p, steps h, (SELECT max(date) AS hi FROM dpanel) e WHERE (h.step - 1) % 7 = p.i""",
    "forecast_seasonal_naive": _forecast("SeasonalNaive"),
    "forecast_moving_average": _forecast("MovingAverage"),
    "forecast_croston": _forecast("CrostonClassic"),
    "forecast_croston_sba": _forecast("CrostonSBA"),
    "forecast_tsb": _forecast("TSB"),
    "forecast_trailing_mean": f"SELECT series_id, CAST(hi + 7 * step AS DATE) AS date, {r('m', 'p10')}, {r('m', 'p50')}, {r('m', 'p90')} FROM (SELECT series_id, avg(y) AS m FROM units WHERE date > (SELECT max(date) FROM units) - 28 GROUP BY 1), (SELECT max(date) AS hi FROM units), steps WHERE step <= {L}",
    "backtest_accuracy": f"SELECT fold, model, n_series, {rs('mase', 'rmsse', 'wrmsse', 'pinball_p10', 'pinball_p50', 'pinball_p90', 'coverage_80')} FROM acc",
    "backtest_summary": f"SELECT model, {', '.join(r(f'avg({c})', c) for c in ('mase', 'rmsse', 'wrmsse', 'coverage_80'))}, abs(avg(coverage_80) - 0.8) > 0.1 AS miscalibrated FROM acc GROUP BY 1",
    "dept_winners": f"SELECT dept_id, model, {r('mase')} FROM (SELECT CASE WHEN contains(series_id, '|') THEN split_part(series_id, '|', 2) ELSE 'parts' END AS dept_id, model, avg(mase) AS mase FROM ps GROUP BY 1, 2) WHERE mase IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dept_id ORDER BY mase, model) = 1",
    "bucket_accuracy": f"SELECT model, CASE WHEN s.zero_rate > 0.5 THEN 'intermittent' ELSE 'regular' END AS bucket, count(*) AS n, {r('avg(mase)', 'mase')}, {r('avg(rmsse)', 'rmsse')} FROM ps LEFT JOIN stats s ON ps.fold = s.fold AND ps.series_id = s.series_id GROUP BY 1, 2",
    "pairwise_correlation": f"SELECT a, b, {rs('pearson_pooled', 'spearman_pooled', 'pearson_level', 'spearman_level', 'mean_series', 'defined')} FROM ({CORR})",
    "mean_abs_diff": f"SELECT a, b, {r('avg(abs(va - vb))', 'mean_abs_diff')}, {r('avg(abs(va - vb)) / nullif(avg(y), 0)', 'of_demand')}, {r('avg(abs(va - vb)) / nullif(0.5 * (avg(abs(va - y)) + avg(abs(vb - y))), 0)', 'of_mae')} FROM pairs GROUP BY 1, 2",
    "close_fractions": f"SELECT a, b, {r('avg(CASE WHEN close THEN 1.0 ELSE 0.0 END)', 'close_share')} FROM {CLOSE} GROUP BY 1, 2",
    "close_summary": f"SELECT {rs('all_close', 'any_close')}, n FROM ({CLOSE_SUMMARY})",
    "leadtime_blocks": f"SELECT model, fold, series_id, block, {rs('p50', 'y')} FROM blocks",
    "leadtime_comparison": f"SELECT x.a, x.b, {', '.join(r(f'{c}_{n}') for n in ('day', 'lead') for c in ('pooled', 'diff', 'of_mae', 'within', 'defined'))} FROM {_side('pairs', 'fold, series_id', 'day')} x JOIN {_side(BLOCK_PAIRS, 'series_id', 'lead')} y ON x.a = y.a AND x.b = y.b",
    "divergence_headline": f"SELECT h.n_pairs, h.n_over, {rs('h.r_min', 'h.r_max', 'c.all_close', 'c.any_close')}, c.n FROM (SELECT count(*) AS n_pairs, CAST(count_if(pearson_pooled > 0.95) AS BIGINT) AS n_over, min(pearson_pooled) AS r_min, max(pearson_pooled) AS r_max FROM ({CORR})) h, ({CLOSE_SUMMARY}) c",
    "representative_series": "SELECT bucket, series_id FROM (SELECT intermittency AS bucket, v.series_id, row_number() OVER (PARTITION BY intermittency ORDER BY m, v.series_id) AS rn, count(*) OVER (PARTITION BY intermittency) AS n FROM (SELECT series_id, avg(y) AS m FROM cache WHERE fold = 1 AND model = 'MovingAverage' GROUP BY 1) v JOIN buckets b ON b.fold = 1 AND b.series_id = v.series_id) WHERE rn = n // 2 + 1",
    "interval_evaluation": f"""SELECT x.model, {rs('native', 'calibrated', 'native_width', 'calibrated_width', 'lead_time', 'below', 'above', 'covered_by_s')} FROM
  (SELECT model, avg(CASE WHEN y BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS native, avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS calibrated, avg(CASE WHEN whole THEN p90 - p10 END) AS native_width, avg(CASE WHEN whole THEN hi - lo END) AS calibrated_width FROM
    (SELECT c.*, greatest(p50 - {d(Z90)} * sigma / sqrt({float(L)}), 0) AS lo, p50 + {d(Z90)} * sigma / sqrt({float(L)}) AS hi, step <= {G.horizon // L * L} AS whole FROM cache c JOIN sigma s ON c.fold = s.fold AND c.model = s.model AND c.series_id = s.series_id) GROUP BY 1) x
  JOIN (SELECT b.model, avg(CASE WHEN abs(y - p50) <= {d(Z90)} * sigma THEN 1.0 ELSE 0.0 END) AS lead_time, avg(CASE WHEN y - p50 < -({d(Z90)} * sigma) THEN 1.0 ELSE 0.0 END) AS below, avg(CASE WHEN y - p50 > {d(Z90)} * sigma THEN 1.0 ELSE 0.0 END) AS above,
    avg(CASE WHEN y - p50 <= {d(1.6448536269514722)} * sigma THEN 1.0 ELSE 0.0 END) AS covered_by_s FROM blocks b JOIN sigma s ON b.fold = s.fold AND b.model = s.model AND b.series_id = s.series_id GROUP BY 1) z ON x.model = z.model""",
    "leadtime_residuals": f"SELECT fold, model, series_id, {r('residual')} FROM res",
    "leadtime_stats": f"SELECT fold, model, series_id, {rs('mean', 'std')} FROM lead",
    "bucket_sigma": f"SELECT fold, model, series_id, {r('sigma')} FROM sigma",
    "volume_quintiles": "SELECT fold, series_id, quintile AS bucket FROM buckets",
    "volume_terciles": "SELECT fold, series_id, tercile AS bucket FROM buckets",
    "safety_stock_normal": f"SELECT fold, model, bucket, n, {rs('std', 'safety_stock')} FROM ({_bucket_stock('intermittency', f'{d(Z95)} * stddev_samp(residual)')})",
    "safety_stock_empirical": f"SELECT x.fold, x.model, x.series_id, b.quintile AS bucket, {r('t.safety_stock')} FROM res x JOIN buckets b ON x.fold = b.fold AND x.series_id = b.series_id JOIN ({_bucket_stock('quintile', f'quantile_cont(residual, {LEVEL})')}) t ON x.fold = t.fold AND x.model = t.model AND b.quintile = t.bucket",
    "within_bucket_dispersion": f"""SELECT model, bucket, n, {rs('p10', 'median', 'p90', 'max')}, {r('p90 / nullif(p10, 0)', 'p90_over_p10')} FROM (SELECT s.model, quintile AS bucket, count(*) AS n, quantile_cont(sd, 0.1) AS p10, quantile_cont(sd, 0.5) AS median, quantile_cont(sd, 0.9) AS p90, max(sd) AS max FROM
  (SELECT model, series_id, stddev_samp(residual) AS sd FROM res GROUP BY 1, 2) s JOIN buckets b ON b.fold = 1 AND b.series_id = s.series_id WHERE sd IS NOT NULL GROUP BY 1, 2)""",
    "buffer_diagnostics": f"""SELECT model, bucket, count(*) AS n, {r('stddev_samp(residual)', 'std')}, {r(f'{d(1.4826)} * median(abs(residual - m))', 'robust_std')}, {r('sum(CASE WHEN rn <= greatest(1, n // 100) THEN sq END) / nullif(sum(sq), 0)', 'top_1pct_share')}, {r('avg(residual)', 'bias')} FROM
  (SELECT *, row_number() OVER (PARTITION BY model, bucket ORDER BY sq DESC, fold, series_id) AS rn FROM (SELECT x.*, (residual - mu) * (residual - mu) AS sq FROM
    (SELECT r.*, b.intermittency AS bucket, median(residual) OVER (PARTITION BY model, b.intermittency) AS m, avg(residual) OVER (PARTITION BY model, b.intermittency) AS mu, count(*) OVER (PARTITION BY model, b.intermittency) AS n FROM res r JOIN buckets b ON r.fold = b.fold AND r.series_id = b.series_id) x)) GROUP BY 1, 2""",
    "reorder_decisions": f"""SELECT fold, model, series_id, {rs('mean', 'std', 'on_hand', 'safety_stock', 'reorder_point', 'order_up_to')}, {r('CASE WHEN on_hand < reorder_point THEN greatest(order_up_to - on_hand, 0) ELSE 0 END', 'order_quantity')},
  {r(f"CASE WHEN std = 0 THEN CASE WHEN on_hand >= mean THEN 0 ELSE 1 END ELSE 1 - ({cdf('xx')}) END", 'stockout_probability')} FROM (SELECT *, (on_hand - mean) / nullif(std, 0) AS xx FROM {DECIDED})""",
    "simulate_ss": f"SELECT fold, model, series_id, {r('s', 'reorder_point')}, {r('up_to', 'order_up_to')}, {r('start', 'on_hand_start')}, {TOTALS}, {rs(*TOTALS_D)} FROM det WHERE lot_multiple = 0",
    "simulate_order_up_to": f"SELECT fold, model, series_id, {r('s', 'reorder_point')}, {r('up_to', 'order_up_to')}, {r('start', 'on_hand_start')}, {TOTALS}, {rs(*TOTALS_D, 'holding_cost', 'stockout_cost', 'total_cost')}, {r('CASE WHEN demanded > 0 THEN shipped / demanded ELSE 1.0 END', 'fill_rate')} FROM det WHERE lot_multiple = 2",
    "policy_summary": f"""SELECT fold, model, lot_multiple, count(*) AS n_series, {r('sum(holding_cost)', 'holding_cost')}, {r('sum(stockout_cost)', 'stockout_cost')}, {r('sum(total_cost)', 'total_cost')}, CAST(sum(cycles) AS BIGINT) AS cycles, {r('avg(safety_stock / nullif(std, 0))', 'mean_safety_factor')},
  {r('CASE WHEN sum(demanded) > 0 THEN sum(shipped) / sum(demanded) ELSE 1.0 END', 'fill_rate')}, {r('1 - sum(stockouts) / nullif(CAST(sum(cycles) AS DOUBLE), 0)', 'csl')}, {r(f'sum(shipped) / nullif(sum(stocked / {G.horizon}), 0)', 'turns')} FROM det GROUP BY 1, 2, 3""",
    "q_stats": f"""SELECT fold, model, lot_multiple, orders, {r('q / nullif(orders, 0)', 'q_mean')}, {r('sqrt(greatest(q2 / nullif(orders, 0) - (q / nullif(orders, 0)) * (q / nullif(orders, 0)), 0)) / nullif(q / nullif(orders, 0), 0)', 'q_cv')}, {r('small / nullif(CAST(orders AS DOUBLE), 0)', 'q_below_one')}, {r('sq', 'sigma_over_q')} FROM
  (SELECT fold, model, lot_multiple, CAST(sum(orders) AS BIGINT) AS orders, sum(qty) AS q, sum(qty_sq) AS q2, sum(small) AS small, median(CASE WHEN orders > 0 THEN std / nullif(qty / orders, 0) END) AS sq FROM det GROUP BY 1, 2, 3)""",
    "stockout_decomposition": f"SELECT model, lot_multiple, CAST(sum(cycles) AS BIGINT) AS cycles, CAST(sum(stockouts) AS BIGINT) AS stockouts, CAST(sum(sizing) AS BIGINT) AS sizing, CAST(sum(stockouts) - sum(sizing) AS BIGINT) AS undershoot, {r('CAST(sum(stockouts) - sum(sizing) AS DOUBLE) / nullif(sum(stockouts), 0)', 'undershoot_share')} FROM det GROUP BY 1, 2",
    "fill_by_volume_decile": f"SELECT lot_multiple, b.decile, {r('sum(shipped) / nullif(sum(demanded), 0)', 'fill_rate')} FROM det JOIN buckets b ON det.fold = b.fold AND det.series_id = b.series_id GROUP BY 1, 2",
    "reprice_grid": " UNION ALL ".join(_reprice(*x) for x in ((0.1, 0.2), (0.25, 0.5), (1.0, None))),
    "cost_components": f"SELECT lot_multiple, model, {rs('holding_per_rate', 'stockout')} FROM parts",
    "breakeven": f"""SELECT lot_multiple, a, b, {r('CASE WHEN rate > 0 THEN rate END', 'rate')}, CASE WHEN sa < sb THEN a WHEN sb < sa THEN b END AS cheaper_below FROM
  (SELECT x.lot_multiple, x.model AS a, y.model AS b, x.stockout AS sa, y.stockout AS sb, (y.stockout - x.stockout) / nullif(x.holding_per_rate - y.holding_per_rate, 0) AS rate FROM parts x JOIN parts y ON x.lot_multiple = y.lot_multiple AND x.model < y.model)""",
    "cost_curve": f"SELECT lot_multiple, model, rate, {r('holding_per_rate * rate + stockout', 'cost')} FROM parts, (VALUES ({d(0.05)}), ({d(0.25)}), ({d(1.0)})) g(rate)",
    "critical_ratio": f"""SELECT model, lot_multiple, {r(_quart(0.1), 'p10')}, {r(_quart(0.5), 'median')}, {r(_quart(0.9), 'p90')} FROM (SELECT model, lot_multiple, cu / nullif(cu + co, 0) AS cr FROM
  (SELECT model, lot_multiple, unit_price * {d(MARGIN)} AS cu, {d(RATE)} * (unit_price * {d(1 - MARGIN)}) * ({G.horizon} / CAST(greatest(orders, 1) AS DOUBLE)) AS co FROM det)) GROUP BY 1, 2""",
    "cycle_length": f"SELECT model, lot_multiple, {r(f'{G.horizon} * count(*) / nullif(CAST(sum(orders) AS DOUBLE), 0)', 'periods')} FROM det GROUP BY 1, 2",
    "implied_ordering_cost": f"SELECT model, lot_multiple, {r('median(k)', 'median_k')}, count(k) AS n FROM (SELECT model, lot_multiple, (qty / nullif(orders, 0)) * (qty / nullif(orders, 0)) * {d(RATE)} * (unit_price * {d(1 - MARGIN)}) / nullif(2 * (demanded / {G.horizon}), 0) AS k FROM det) GROUP BY 1, 2",
    "sweep_curve": f"SELECT target_id, lot_multiple, model, {rs('total_cost', 'holding_cost', 'stockout_cost', 'csl', 'fill')} FROM curve",
    "sweep_optimum": f"SELECT lot_multiple, target_id, {r('c', 'total_cost')}, target_id = lo OR target_id = hi AS on_edge FROM (SELECT lot_multiple, target_id, c, min(target_id) OVER (PARTITION BY lot_multiple) AS lo, max(target_id) OVER (PARTITION BY lot_multiple) AS hi, row_number() OVER (PARTITION BY lot_multiple ORDER BY c, target_id) AS rn FROM (SELECT lot_multiple, target_id, avg(total_cost) AS c FROM curve GROUP BY 1, 2)) WHERE rn = 1",
    "sweep_nominal": "SELECT lot_multiple, min(CASE WHEN csl >= 0.9 THEN target_id END) AS target_id FROM (SELECT lot_multiple, target_id, avg(csl) AS csl FROM curve GROUP BY 1, 2) GROUP BY 1",
    "sweep_flat_from": "SELECT lot_multiple, min(CASE WHEN c <= 1.02::DOUBLE * least_c THEN target_id END) AS target_id FROM (SELECT *, min(c) OVER (PARTITION BY lot_multiple) AS least_c FROM (SELECT lot_multiple, target_id, avg(total_cost) AS c FROM curve GROUP BY 1, 2)) GROUP BY 1",
    "choose_multiple": f"""SELECT lot_multiple, {r('cost')}, {r('base - cost', 'saving')} FROM (SELECT *, max(CASE WHEN lot_multiple = 0 THEN cost END) OVER () AS base, row_number() OVER (ORDER BY cost, lot_multiple) AS rn FROM
  (SELECT lot_multiple, avg(c) AS cost FROM (SELECT lot_multiple, model, avg(c) AS c FROM (SELECT lot_multiple, model, fold, sum(total_cost) AS c FROM det GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)) WHERE rn = 1""",
    "sweep_walk_forward": f"""SELECT p.lot_multiple, p.fold, p.target_id, {r('p.c', 'cost')}, {r('f.c', 'base_cost')} FROM
  (SELECT *, row_number() OVER (PARTITION BY lot_multiple, fold ORDER BY past, target_id) AS rn FROM (SELECT *, avg(c) OVER (PARTITION BY lot_multiple, target_id ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM fc) WHERE past IS NOT NULL) p
  LEFT JOIN fc f ON f.lot_multiple = p.lot_multiple AND f.fold = p.fold AND f.target_id = {target_id(LEVEL)} WHERE rn = 1""",
    "cost_ranking": f"SELECT lot_multiple, model, {r('cost')}, rank() OVER (PARTITION BY lot_multiple ORDER BY cost) + (count(*) OVER (PARTITION BY lot_multiple, cost) - 1) / 2.0::DOUBLE AS rank FROM (SELECT lot_multiple, model, avg(c) AS cost FROM (SELECT lot_multiple, model, fold, sum(total_cost) AS c FROM det GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    "clean_lines_log": f"""SELECT CASE WHEN NOT regexp_matches(stock_code, '^\\d{{5}}[A-Za-z]{{0,2}}$') THEN '1 not a product code' WHEN NOT starts_with(invoice, 'C') AND NOT quantity > 0 THEN '2 negative, no cancellation' WHEN NOT coalesce(price_gbp > 0, false) THEN '3 price not positive' ELSE 'kept' END AS rule,
  count(*) AS n_rows, {r('sum(greatest(quantity, 0))', 'sold_units')}, {r('sum(greatest(-quantity, 0))', 'returned_units')} FROM inv GROUP BY 1""",
    "hierarchy_levels": f"SELECT CAST(4 - (grouping(region) + grouping(nation) + grouping(type) + grouping(brand)) AS INT) AS level, concat_ws('/', region, nation, type, brand) AS node, date, {r('sum(units)', 'y')} FROM geo GROUP BY GROUPING SETS ((region, date), (region, nation, date), (region, nation, type, date), (region, nation, type, brand, date))",
    "bottom_up": f"SELECT CAST(4 - (grouping(region) + grouping(nation) + grouping(type) + grouping(brand)) AS INT) AS level, concat_ws('/', region, nation, type, brand) AS node, date, {r('sum(units)', 'p50')} FROM geo GROUP BY GROUPING SETS ((region, date), (region, nation, date), (region, nation, type, date), (region, nation, type, brand, date))",
    "rolling_error": f"SELECT l.series_id, date, {rs('l.y', 'forecast')}, {r('l.y - forecast', 'error')}, {r('abs(l.y - forecast)', 'abs_error')}, {r('avg(abs(l.y - forecast)) OVER (PARTITION BY l.series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / nullif(s.scale, 0)', 'rolling_mase')} FROM log l JOIN (SELECT series_id, avg(y) AS scale FROM log GROUP BY 1) s ON s.series_id = l.series_id",
    "error_spikes": "SELECT DISTINCT series_id FROM (SELECT l.series_id, avg(abs(l.y - forecast)) OVER (PARTITION BY l.series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / nullif(s.scale, 0) AS m FROM log l JOIN (SELECT series_id, avg(y) AS scale FROM log GROUP BY 1) s ON s.series_id = l.series_id) WHERE m > 0.2",
    "input_drift": f"SELECT b.series_id, {r('abs(c.m - b.m)', 'shift')}, {r('b.sd', 'std')} FROM (SELECT series_id, avg(y) AS m, stddev_samp(y) AS sd FROM log WHERE date < DATE '2024-01-22' GROUP BY 1) b JOIN (SELECT series_id, avg(y) AS m FROM log WHERE date >= DATE '2024-01-22' GROUP BY 1) c ON b.series_id = c.series_id WHERE (b.sd = 0 AND abs(c.m - b.m) > 0) OR (b.sd > 0 AND abs(c.m - b.m) > 0.1 * b.sd)",
}
EXTRA = """,
zc AS (SELECT u.*, CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END AS zr, date < (SELECT min(date) FROM units) + 364 AS early, date IN (SELECT date FROM units GROUP BY 1 HAVING sum(y) < 0.05 * (SELECT median(t) FROM (SELECT sum(y) AS t FROM units GROUP BY date))) AS closed FROM units u),
fc AS (SELECT fold, target_id, lot_multiple, avg(c) AS c FROM (SELECT fold, target_id, lot_multiple, model, sum(total_cost) AS c FROM swept GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
"""
ORACLES = {name: CHAIN + EXTRA + body for name, body in BODY.items()}
