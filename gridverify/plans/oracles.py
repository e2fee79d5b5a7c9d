"""SQL forms of the queries, written on their own terms for DuckDB.

They run on the same tables and serve as an independent check: regridding
compares all pairs of coordinates, histograms test every edge and density
curves sum every kernel.
"""

from __future__ import annotations

# --- the tables in their roles ---------------------------------------------------

M = """m AS (
  SELECT l_shipdate AS time, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS member,
         CAST(l_suppkey // 10 AS INT) AS iy, CAST(l_suppkey % 10 AS INT) AS ix,
         l_quantity AS value
  FROM lineitem)"""
E = M + ",\ne AS (SELECT * FROM m WHERE member <> '01')"
ER = E + ",\nr AS (SELECT time, iy, ix, value FROM m WHERE member = '01')"
H = """h AS (
  SELECT ts AS time, event_type AS member, CAST(user_id // 10 AS INT) AS iy,
         CAST(user_id % 10 AS INT) AS ix, value
  FROM events)"""
W = """w AS (
  SELECT o_orderdate AS time, CAST(split_part(o_orderpriority, '-', 1) AS INT) AS slwt
  FROM orders)"""
DEM = """dem AS (
  SELECT CAST(s_suppkey // 10 AS INT) AS iy, CAST(s_suppkey % 10 AS INT) AS ix,
         s_acctbal AS altitude
  FROM supplier)"""


def cells(name: str = "cells", lat0: str = "46e0", lon0: str = "10e0") -> str:
    return f"""{name} AS (
  SELECT CAST(s_suppkey // 10 AS INT) AS iy, CAST(s_suppkey % 10 AS INT) AS ix,
         {lat0} + 0.25e0 * CAST(s_suppkey // 10 AS INT) AS lat,
         {lon0} + 0.25e0 * CAST(s_suppkey % 10 AS INT) AS lon
  FROM supplier)"""


ROTATED = f"""{cells()},
rotated AS (SELECT iy, ix, lat - 0.0625e0 * ix AS lat, lon - 0.03125e0 * iy AS lon FROM cells)"""

FINE = """steps AS (SELECT * FROM (VALUES (0, 0e0), (1, 0.125e0), (2, 0.1875e0)) AS v(k, d)),
fine AS (
  SELECT c.iy * 3 + sy.k AS iy, c.ix * 3 + sx.k AS ix, c.lat + sy.d AS lat, c.lon + sx.d AS lon
  FROM cells c CROSS JOIN steps sy CROSS JOIN steps sx)"""

DAY = "CAST(time AS DATE)"
MONTH = "last_day(time)"
YEAR = "make_date(year(time), 12, 31)"
SEASON = """CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) IN (3, 4, 5) THEN 'MAM'
       WHEN month(time) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"""
LABELS = {
    "daily": ("time", DAY),
    "monthly": ("time", MONTH),
    "seasonal": ("season", SEASON),
    "yearly": ("time", YEAR),
}
METHODS = {"sum": "coalesce(sum(value), 0)", "mean": "avg(value)"}
BANDS = """bands AS (
  SELECT * FROM (VALUES (0e0, 500e0), (500e0, 1000e0), (1000e0, 2000e0), (2000e0, 5000e0))
  AS v(bin_min, bin_max))"""


def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0e0" + (f" AS {name}" if name else "")


def text(expression: str, name: str = "time") -> str:
    return f"CAST({expression} AS VARCHAR) AS {name}"


def summed(source: str, period: str, keys: str, method: str = "sum", value: str = "value") -> str:
    name, label = LABELS[period]
    reduced = METHODS[method].replace("value", value)
    return f"SELECT {label} AS {name}, {keys}, {reduced} AS value FROM {source} GROUP BY ALL"


def sides(period: str) -> str:
    return (
        f"WITH {ER},\nea AS ({summed('e', period, 'member, iy, ix')}),\n"
        f"ra AS ({summed('r', period, 'iy, ix')}),\n"
        "p AS (SELECT ea.* EXCLUDE (value), ea.value - ra.value AS d FROM ea JOIN ra "
        f"USING ({LABELS[period][0]}, iy, ix))"
    )


ME, MAE, RMSE = r("avg(d)"), r("avg(abs(d))"), r("sqrt(avg(d * d))")
SCORES = f"{ME} AS ME, {MAE} AS MAE, {RMSE} AS RMSE"


def axis_map(name: str, axis: str, coordinate: str, source: str, target: str) -> str:
    """Nearest source index per target index by comparing every pair; axes from the first column or row."""
    other = "ix" if axis == "iy" else "iy"
    return f"""{name}_s AS (SELECT {axis} AS i, arg_min({coordinate}, {other}) AS c FROM {source} GROUP BY {axis}),
{name}_t AS (SELECT {axis} AS i, arg_min({coordinate}, {other}) AS c FROM {target} GROUP BY {axis}),
{name} AS (
  SELECT t.i AS t_{axis}, s.i AS {axis},
         t.c BETWEEN (SELECT min(c) FROM {name}_s) AND (SELECT max(c) FROM {name}_s) AS in_{axis}
  FROM {name}_t t CROSS JOIN {name}_s s
  QUALIFY row_number() OVER (PARTITION BY t.i ORDER BY abs(t.c - s.c), s.c) = 1)"""


def both_maps(source: str, target: str) -> str:
    return (
        axis_map("ymap", "iy", "lat", source, target)
        + ",\n"
        + axis_map("xmap", "ix", "lon", source, target)
    )


def linear_map(name: str, axis: str, coordinate: str) -> str:
    return f"""{name}_s AS (SELECT DISTINCT {axis} AS i, {coordinate} AS c FROM cells),
{name}_t AS (SELECT DISTINCT {axis} AS i, {coordinate} AS c FROM fine),
{name}_n AS (
  SELECT t.i, t.c, max(s.c) FILTER (s.c < t.c) AS lo, min(s.c) FILTER (s.c >= t.c) AS hi
  FROM {name}_t t CROSS JOIN {name}_s s GROUP BY ALL),
{name} AS (
  SELECT n.i AS t, a.i AS lo, b.i AS hi,
         CASE WHEN n.lo IS NULL OR n.hi IS NULL THEN 0 ELSE (n.c - n.lo) / (n.hi - n.lo) END AS w,
         n.hi IS NOT NULL AND (n.lo IS NOT NULL OR n.hi = n.c) AS inside
  FROM {name}_n n
  JOIN {name}_s a ON a.c = coalesce(n.lo, n.hi) JOIN {name}_s b ON b.c = coalesce(n.hi, n.lo))"""


def knots(name: str, axis: str, coordinate: str) -> str:
    """Source coordinates in order, and the two around each target coordinate."""
    return f"""{name}_s AS (
  SELECT i, c, row_number() OVER (ORDER BY c) AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT {axis} AS i, {coordinate} AS c FROM cells)),
{name}_t AS (
  SELECT t.i, t.c, max(s.k) FILTER (s.c < t.c) AS lo, min(s.k) FILTER (s.c >= t.c) AS hi, min(s.c) FILTER (s.c >= t.c) AS hi_c, any_value(n) AS n
  FROM (SELECT DISTINCT {axis} AS i, {coordinate} AS c FROM fine) t CROSS JOIN {name}_s s GROUP BY t.i, t.c)"""


def cubic_pass(name: str, source: str, key: str, axis: str, coordinate: str) -> str:
    """Cubic splines with not-a-knot ends along one axis: a plain elimination of each line's second derivatives.

    Of fewer than four coordinates, the polynomial through them. Every line has all its cells.
    """
    return f"""{knots(name, axis, coordinate)},
{name}_y AS (SELECT a.{key} AS line, k, c, n, value AS y FROM {source} a JOIN {name}_s s ON a.{axis} = s.i),
{name}_h AS (
  SELECT *, c - lag(c) OVER w AS hp, lead(c) OVER w - c AS hn, lag(y) OVER w AS yp, lead(y) OVER w AS yn
  FROM {name}_y WINDOW w AS (PARTITION BY line ORDER BY k)),
{name}_r AS (
  SELECT line, k, n, 6 * ((yn - y) / hn - (y - yp) / hp) AS g,
         2 * (hp + hn) + CASE WHEN k = 2 THEN hp + hp * hp / hn WHEN k = n - 1 THEN hn + hn * hn / hp ELSE 0 END AS d,
         hn - CASE WHEN k = 2 THEN hp * hp / hn ELSE 0 END AS u, hp - CASE WHEN k = n - 1 THEN hn * hn / hp ELSE 0 END AS l
  FROM {name}_h WHERE k > 1 AND k < n AND n > 3),
{name}_f AS (
  SELECT line, k, n, u / d AS p, g / d AS q FROM {name}_r WHERE k = 2
  UNION ALL
  SELECT r.line, r.k, r.n, r.u / (r.d - r.l * f.p), (r.g - r.l * f.q) / (r.d - r.l * f.p)
  FROM {name}_f f JOIN {name}_r r ON r.line = f.line AND r.k = f.k + 1),
{name}_b AS (
  SELECT line, k, q AS m FROM {name}_f WHERE k = n - 1
  UNION ALL
  SELECT f.line, f.k, f.q - f.p * b.m FROM {name}_b b JOIN {name}_f f ON f.line = b.line AND f.k = b.k - 1),
{name}_m AS (
  SELECT line, k, m FROM {name}_b
  UNION ALL
  SELECT a.line, 1, a.m + h.hp / h.hn * (a.m - b.m)
  FROM {name}_b a JOIN {name}_b b ON a.line = b.line AND a.k = 2 AND b.k = 3 JOIN {name}_h h ON h.line = a.line AND h.k = 2
  UNION ALL
  SELECT a.line, h.n, a.m + h.hn / h.hp * (a.m - b.m)
  FROM {name}_h h JOIN {name}_b a ON h.line = a.line AND a.k = h.k JOIN {name}_b b ON b.line = a.line AND b.k = h.k - 1
  WHERE h.k = h.n - 1 AND h.n > 3),
{name}_w AS (
  SELECT t.i, j.k, coalesce(product((t.c - o.c) / (j.c - o.c)), 1) AS w
  FROM {name}_t t CROSS JOIN {name}_s j LEFT JOIN {name}_s o ON o.k <> j.k WHERE t.n < 4 GROUP BY t.i, j.k),
{name}_p AS (SELECT w.i, y.line, sum(w.w * y.y) AS value FROM {name}_w w JOIN {name}_y y USING (k) GROUP BY ALL),
{name} AS (
  SELECT x.line AS {key}, t.i AS {axis}, CASE
    WHEN t.hi IS NULL OR (t.lo IS NULL AND t.hi_c <> t.c) THEN NULL
    WHEN t.hi_c = t.c THEN b.y
    WHEN t.n < 4 THEN p.value
    ELSE ((b.c - t.c) * a.y + (t.c - a.c) * b.y) / (b.c - a.c)
       + (power((b.c - t.c) / (b.c - a.c), 3) - (b.c - t.c) / (b.c - a.c)) * power(b.c - a.c, 2) / 6 * ma.m
       + (power((t.c - a.c) / (b.c - a.c), 3) - (t.c - a.c) / (b.c - a.c)) * power(b.c - a.c, 2) / 6 * mb.m END AS value
  FROM {name}_t t CROSS JOIN (SELECT DISTINCT line FROM {name}_y) x
  LEFT JOIN {name}_y a ON a.line = x.line AND a.k = t.lo LEFT JOIN {name}_y b ON b.line = x.line AND b.k = t.hi
  LEFT JOIN {name}_m ma ON ma.line = x.line AND ma.k = t.lo LEFT JOIN {name}_m mb ON mb.line = x.line AND mb.k = t.hi
  LEFT JOIN {name}_p p ON p.line = x.line AND p.i = t.i)"""


def pchip_pass(name: str, source: str, keys: str, axis: str, coordinate: str) -> str:
    """Monotone cubic along one axis: a slope at every source value, then Hermite's form between two of them."""
    by = [k.strip() for k in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in by)
    at = lambda alias, k: f"LEFT JOIN {name}_y {alias} ON {same(alias, 'v')} AND {alias}.k = {k}"
    slope = lambda a, b: f"(({b}.y - {a}.y) / ({b}.c - {a}.c))"

    def end(a: str, b: str, c: str) -> str:
        near, far = slope(a, b), slope(b, c)
        h, g = f"abs({b}.c - {a}.c)", f"abs({c}.c - {b}.c)"
        d = f"(((2 * {h} + {g}) * {near} - {h} * {far}) / ({h} + {g}))"
        return f"""CASE WHEN sign({d}) <> sign({near}) THEN 0 WHEN sign({near}) <> sign({far}) AND abs({d}) > 3 * abs({near})
           THEN 3 * {near} ELSE {d} END"""

    before, after = slope("p", "v"), slope("v", "q")
    h, g = "(v.c - p.c)", "(q.c - v.c)"
    inner = f"""CASE WHEN {before} * {after} <= 0 THEN 0
           ELSE 3 * ({h} + {g}) / ((2 * {g} + {h}) / {before} + ({g} + 2 * {h}) / {after}) END"""
    cols = ", ".join(f"v.{k}" for k in by)
    return f"""{knots(name, axis, coordinate)},
{name}_y AS (SELECT {', '.join(f'a.{k}' for k in by)}, k, c, n, value AS y FROM {source} a JOIN {name}_s s ON a.{axis} = s.i),
{name}_d AS (
  SELECT {cols}, v.k, v.c, v.y, CASE
      WHEN v.n = 2 AND v.k = 1 THEN {after} WHEN v.n = 2 THEN {before}
      WHEN v.k = 1 THEN {end('v', 'q', 'qq')} WHEN v.k = v.n THEN {end('v', 'p', 'pp')} ELSE {inner} END AS d
  FROM {name}_y v {at('p', 'v.k - 1')} {at('q', 'v.k + 1')} {at('pp', 'v.k - 2')} {at('qq', 'v.k + 2')}),
{name}_e AS (
  SELECT DISTINCT {cols}, t.i, t.c, t.lo, t.hi, t.hi_c
  FROM {name}_y v JOIN {name}_t t ON CASE WHEN t.hi_c = t.c THEN v.k = t.hi
    WHEN t.lo IS NULL OR t.hi IS NULL THEN v.k = coalesce(t.lo, t.hi) ELSE v.k BETWEEN t.lo - 1 AND t.hi + 1 END),
{name} AS (
  SELECT {cols}, v.i AS {axis}, CASE
    WHEN v.hi_c = v.c THEN b.y
    WHEN v.lo IS NOT NULL AND v.hi IS NOT NULL THEN
      a.y + (v.c - a.c) * (a.d + (v.c - a.c) / (b.c - a.c) * (3 * {slope('a', 'b')} - 2 * a.d - b.d
        + (v.c - a.c) / (b.c - a.c) * (a.d + b.d - 2 * {slope('a', 'b')}))) END AS value
  FROM {name}_e v LEFT JOIN {name}_d a ON {same('a', 'v')} AND a.k = v.lo LEFT JOIN {name}_d b ON {same('b', 'v')} AND b.k = v.hi)"""


def histogram(values: str, by: str, bins: int) -> str:
    keys = f"{by}, " if by else ""
    match = " AND ".join(
        [f"v.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in by.split(",") if k.strip()]
        + [f"v.value >= b.bin_left AND (v.value < b.bin_right OR b.bin = {bins - 1})"]
    )
    keyed = "".join(f"b.{k.strip()}, " for k in by.split(",") if k.strip())
    return f"""lim0 AS (
  SELECT {keys}min(value) AS lo, max(value) AS hi FROM {values} WHERE value IS NOT NULL GROUP BY ALL),
lim AS (
  SELECT {keys}CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo,
         CASE WHEN lo = hi THEN hi + 0.5e0 ELSE hi END AS hi FROM lim0 WHERE lo IS NOT NULL),
edges AS (
  SELECT {keys}CAST(i AS INT) AS bin, i * ((hi - lo) / {bins}) + lo AS bin_left,
         CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * ((hi - lo) / {bins}) + lo END AS bin_right
  FROM lim CROSS JOIN range({bins}) AS g(i))
SELECT {keyed}b.bin, {r('b.bin_left', 'bin_left')}, {r('b.bin_right', 'bin_right')},
       count(v.value) AS count
FROM edges b LEFT JOIN {values} v ON {match}
GROUP BY {keyed}b.bin, b.bin_left, b.bin_right"""


def density(values: str, by: str) -> str:
    keys = [k.strip() for k in by.split(",")]
    keyed = "".join(f"s.{k}, " for k in keys)
    match = " AND ".join(f"v.{k} = s.{k}" for k in keys)
    return f"""shape AS (
  SELECT {by}, min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd,
         stddev_samp(value) * pow(count(value), -0.2e0) AS h
  FROM {values} WHERE value IS NOT NULL GROUP BY ALL),
grid AS (
  SELECT s.*, CAST(i AS INT) AS point,
         CASE WHEN i = 199 THEN hi ELSE lo + i * (hi - lo) / 199 END AS x
  FROM shape s CROSS JOIN range(200) AS g(i) WHERE n >= 2 AND sd > 0)
SELECT {keyed}s.point, {r('s.x', 'x')},
       {r('sum(exp(-0.5e0 * pow((s.x - v.value) / s.h, 2))) / (s.n * s.h * sqrt(2 * pi()))', 'density')}
FROM grid s JOIN {values} v ON {match} WHERE v.value IS NOT NULL
GROUP BY {keyed}s.point, s.x, s.n, s.h"""


def line_spec(dash: str) -> str:
    rows = []
    for low, high in ((0, 2000), (1000, 6000)):
        for member in ("02", "03", "mean"):
            rows.append(f"('ens{dash}{member}_{low}-{high}', 'ensemble', '{member}', {low}e0, {high}e0)")
        rows.append(f"('ref{dash}na_{low}-{high}', 'reference', NULL, {low}e0, {high}e0)")
    return "spec AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(line, source, choice, lo, hi))"


def line_rows(period: str, dash: str = "_") -> str:
    return f"""WITH {ER}, {DEM}, {line_spec(dash)},
ea AS ({summed('e', period, 'member, iy, ix')}),
ra AS ({summed('r', period, 'iy, ix')}),
alle AS (
  SELECT time, iy, ix, member, member AS choice, value FROM ea
  UNION ALL
  SELECT time, iy, ix, NULL, 'mean', avg(value) FROM ea GROUP BY ALL),
lv AS (
  SELECT line, source, time, member, value
  FROM alle JOIN dem USING (iy, ix) JOIN spec USING (choice)
  WHERE source = 'ensemble' AND altitude >= lo AND altitude < hi
  UNION ALL
  SELECT line, source, time, NULL, value
  FROM ra JOIN dem USING (iy, ix) JOIN spec ON source = 'reference'
  WHERE altitude >= lo AND altitude < hi)"""


BANDED = f"""WITH {M}, {DEM}, {BANDS},
ma AS ({summed('m', 'monthly', 'member, iy, ix')}),
bv AS (
  SELECT ma.*, bin_min, bin_max FROM ma JOIN dem USING (iy, ix)
  JOIN bands ON altitude >= bin_min AND altitude < bin_max)"""

TIMES = "time >= TIMESTAMP '1995-03-01 00:00:00' AND time < TIMESTAMP '2001-06-16 00:00:00'"
INCLUDED = f"SELECT DISTINCT {DAY} FROM w WHERE slwt IN (1, 2)"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # aggregation in time
    for period, (name, label) in LABELS.items():
        for method, reduced in METHODS.items():
            sql[f"agg_{period}_{method}"] = f"""WITH {M}
SELECT {text(label, name)}, member, iy, ix, {r(reduced, 'value')} FROM m GROUP BY ALL"""
    sql["agg_none"] = f"""WITH {M}
SELECT {text('time')}, member, iy, ix, nullif(value, 50) AS value FROM m"""
    sql["agg_monthly_min_count"] = f"""WITH {M}
SELECT {text(MONTH)}, member, iy, ix, {r('sum(nullif(value, 50))', 'value')} FROM m GROUP BY ALL"""
    sql["ensemble_mean_daily"] = f"""WITH {E},
a AS (SELECT time, iy, ix, avg(value) AS value FROM e GROUP BY ALL)
SELECT {text(DAY)}, iy, ix, {r('sum(value)', 'value')} FROM a GROUP BY ALL"""
    sql["ensemble_mean_hourly_data"] = f"""WITH {H},
a AS (SELECT time, iy, ix, avg(value) AS value FROM h GROUP BY ALL)
SELECT {text(DAY)}, iy, ix, {r('avg(value)', 'value')} FROM a GROUP BY ALL"""
    sql["weather_group_mean"] = f"""WITH {M}, {W},
d AS (SELECT DISTINCT {DAY} AS day, slwt FROM w)
SELECT slwt, member, iy, ix, {r('avg(value)', 'value')}
FROM m JOIN d ON {DAY} = day GROUP BY ALL"""

    # selections
    sql["included_days"] = f"WITH {W} SELECT DISTINCT {text(DAY, 'day')} FROM w WHERE slwt IN (1, 2)"
    sql["weather_filter"] = f"""WITH {M}, {W}
SELECT {text('time')}, member, iy, ix, value FROM m WHERE {DAY} IN ({INCLUDED})"""
    sql["time_slice"] = f"WITH {M} SELECT {text('time')}, member, iy, ix, value FROM m WHERE {TIMES}"
    sql["member_select"] = f"""WITH {M}
SELECT {text('time')}, member, iy, ix, value FROM m WHERE member IN ('02', '05', '07')"""
    sql["bbox_subset"] = f"""WITH {M}, {cells()}
SELECT {text('time')}, member, iy, ix, value FROM m JOIN cells USING (iy, ix)
WHERE lat BETWEEN 46.25 AND 1e9 AND lon BETWEEN 10.25 AND 12"""
    sql["bbox_cells"] = f"""WITH {M}, {DEM},
hit AS (SELECT iy, ix FROM dem WHERE altitude BETWEEN 0 AND 3000)
SELECT member, iy, ix, CASE WHEN altitude BETWEEN 0 AND 3000 THEN sum(value) END AS value
FROM m JOIN dem USING (iy, ix)
WHERE iy IN (SELECT iy FROM hit) AND ix IN (SELECT ix FROM hit)
GROUP BY member, iy, ix, altitude"""

    # repairs and masks
    sql["sentinel_fix"] = sql["agg_none"]
    sql["scale_factor"] = f"""WITH {M}
SELECT {text('time')}, member, iy, ix, {r('value * 0.1e0', 'value')} FROM m"""
    sql["unit_celsius"] = f"""SELECT event_id, event_type,
  {r("CASE WHEN event_type IN ('view', 'purchase', 'error') THEN value - 273.15e0 ELSE value END", 'value')}
FROM events"""
    sql["wet_filter_daily"] = f"""WITH {M}
SELECT {text(DAY)}, member, iy, ix, coalesce(sum(value) FILTER (value >= 5), 0) AS value
FROM m GROUP BY ALL"""
    sql["wet_filter_zero"] = f"""WITH {M}
SELECT {text(MONTH)}, member, iy, ix,
       {r('avg(CASE WHEN value = 50 THEN NULL WHEN value >= 5 THEN value ELSE 0 END)', 'value')}
FROM m GROUP BY ALL"""
    sql["range_filter"] = f"""WITH {M}
SELECT {text(MONTH)}, member, iy, ix, {r('avg(value) FILTER (value >= 10 AND value < 40)', 'value')}
FROM m GROUP BY ALL"""
    sql["flattened_values"] = f"WITH {M} SELECT value FROM m WHERE value <> 50"
    sql["member_from_name"] = f"""WITH {M}
SELECT 'total_' || strftime(time, '%Y%m%d') || '_' || member || '.parquet' AS file_name, member,
       count(*) AS n_rows FROM m GROUP BY ALL"""
    sql["merge_by_coords"] = f"""WITH {M},
q AS (SELECT {DAY} AS time, member, iy, ix, sum(value) AS value FROM m GROUP BY ALL),
d AS (
  SELECT CAST(l_shipdate + INTERVAL 7 DAY AS DATE) AS time, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS member,
         CAST(l_suppkey // 10 AS INT) AS iy, CAST(l_suppkey % 10 AS INT) AS ix,
         avg(l_discount) AS discount
  FROM lineitem GROUP BY ALL)
SELECT {text('time')}, member, iy, ix, {r('value', 'value')}, {r('discount', 'discount')}
FROM q FULL JOIN d USING (time, member, iy, ix)"""
    sql["repeated_labels"] = f"""WITH {M}
SELECT {text('time')}, member, iy, ix, count(*) AS n_rows FROM m GROUP BY ALL HAVING count(*) > 1"""

    # quality
    sql["missing_count"] = f"WITH {M} SELECT count(*) FILTER (value = 50) AS missing FROM m"
    sql["outlier_count"] = f"""WITH {M}
SELECT count(*) FILTER (value > 45 AND value <> 50) AS outliers FROM m"""
    sql["quality_report"] = f"""WITH {M}, {H}
SELECT 'ensemble' AS source, count(*) AS n_rows, count(*) FILTER (value = 50) AS missing,
       count(*) FILTER (value > 40 AND value <> 50) AS outliers FROM m
UNION ALL
SELECT 'reference', count(*), count(*) FILTER (value IS NULL), count(*) FILTER (value > 40) FROM h"""
    summary = f"""count(*) AS n_rows, count(DISTINCT time) AS n_times,
       {text('min(time)', 'first_time')}, {text('max(time)', 'last_time')},
       count(DISTINCT (iy, ix)) AS n_cells, %s AS n_members,
       count(value) AS n_value, min(value) AS min_value, max(value) AS max_value"""
    sql["profile"] = f"WITH {M} SELECT {summary % 'count(DISTINCT member)'} FROM m"
    sql["inspect_inputs"] = f"""WITH {ER}
SELECT 'ensemble' AS source, {summary % 'count(DISTINCT member)'} FROM e
UNION ALL
SELECT 'reference' AS source, {summary % 'CAST(NULL AS BIGINT)'} FROM r"""

    # grid
    sql["axes_from_grid"] = f"""WITH {ROTATED},
y AS (SELECT iy, arg_min(lat, ix) AS lat FROM rotated GROUP BY iy),
x AS (SELECT ix, arg_min(lon, iy) AS lon FROM rotated GROUP BY ix)
SELECT c.iy, c.ix, {r('y.lat', 'lat_coord')}, {r('x.lon', 'lon_coord')}
FROM rotated c JOIN y ON c.iy = y.iy JOIN x ON c.ix = x.ix"""
    sql["cells_from_data"] = f"""WITH {M}, {ROTATED}
SELECT DISTINCT iy, ix, {r('lat', 'lat')}, {r('lon', 'lon')} FROM m JOIN rotated USING (iy, ix)"""
    sql["dem_prepared"] = f"""WITH {DEM}, {cells()}
SELECT iy, ix, altitude, lat AS lat_coord, lon AS lon_coord FROM dem JOIN cells USING (iy, ix)
WHERE lat BETWEEN 46.25 AND 1e9 AND lon BETWEEN 10.25 AND 12"""
    sql["dem_attach"] = f"""WITH {H}, {DEM},
a AS ({summed('h', 'daily', 'member, iy, ix')})
SELECT {text('time')}, member, a.iy, a.ix, {r('value', 'value')}, altitude
FROM a LEFT JOIN dem ON a.iy = dem.iy AND a.ix = dem.ix"""
    sql["regrid_nearest"] = f"""WITH {M}, {ROTATED}, {FINE},
{both_maps('rotated', 'fine')},
a AS ({summed('m', 'seasonal', 'iy, ix', 'mean')})
SELECT season, t_iy AS iy, t_ix AS ix, {r('CASE WHEN in_iy AND in_ix THEN value END', 'value')}
FROM a JOIN ymap USING (iy) JOIN xmap USING (ix)"""
    sql["regrid_bilinear"] = f"""WITH {M}, {cells()}, {FINE},
{linear_map('yl', 'iy', 'lat')},
{linear_map('xl', 'ix', 'lon')},
a AS (SELECT iy, ix, avg(value) AS value FROM m GROUP BY ALL)
SELECT yl.t AS iy, xl.t AS ix, {r('''CASE WHEN yl.inside AND xl.inside THEN
  (1 - yl.w) * ((1 - xl.w) * a00.value + xl.w * a01.value)
  + yl.w * ((1 - xl.w) * a10.value + xl.w * a11.value) END''', 'value')}
FROM yl CROSS JOIN xl
JOIN a a00 ON a00.iy = yl.lo AND a00.ix = xl.lo JOIN a a01 ON a01.iy = yl.lo AND a01.ix = xl.hi
JOIN a a10 ON a10.iy = yl.hi AND a10.ix = xl.lo JOIN a a11 ON a11.iy = yl.hi AND a11.ix = xl.hi"""
    sql["regrid_cubic"] = f"""WITH RECURSIVE {M}, {cells()}, {FINE},
a AS (SELECT iy, ix, avg(value) AS value FROM m GROUP BY ALL),
{cubic_pass('cx', 'a', 'iy', 'ix', 'lon')},
{cubic_pass('cy', 'cx', 'ix', 'iy', 'lat')}
SELECT iy, ix, {r('value', 'value')} FROM cy"""
    sql["regrid_pchip"] = f"""WITH {M}, {cells()}, {FINE},
a AS (SELECT iy, ix, avg(value) AS value FROM m GROUP BY ALL),
{pchip_pass('px', 'a', 'iy', 'ix', 'lon')},
{pchip_pass('py', 'px', 'ix', 'iy', 'lat')}
SELECT iy, ix, {r('value', 'value')} FROM py"""
    sql["regrid_terrain"] = f"""WITH {DEM}, {cells()}, {FINE},
{both_maps('cells', 'fine')}
SELECT t_iy AS iy, t_ix AS ix, CASE WHEN in_iy AND in_ix THEN altitude END AS altitude
FROM dem JOIN ymap USING (iy) JOIN xmap USING (ix)"""

    # scores
    sql["bias_me_map"] = f"{sides('monthly')} SELECT iy, ix, {ME} AS ME FROM p GROUP BY ALL"
    sql["bias_mae_map"] = f"{sides('monthly')} SELECT iy, ix, {MAE} AS MAE FROM p GROUP BY ALL"
    sql["bias_rmse_map"] = f"{sides('monthly')} SELECT member, iy, ix, {RMSE} AS RMSE FROM p GROUP BY ALL"
    sql["bias_scalar"] = f"{sides('monthly')} SELECT {SCORES} FROM p"
    sql["bias_by_member"] = f"{sides('daily')} SELECT member, {SCORES} FROM p GROUP BY ALL"
    sql["bias_by_season"] = f"{sides('seasonal')} SELECT season, member, {SCORES} FROM p GROUP BY ALL"
    sql["bias_by_year"] = f"""{sides('yearly')},
s AS (SELECT time, {SCORES} FROM p GROUP BY ALL)
SELECT {text('time')}, metric, score FROM s UNPIVOT (score FOR metric IN (ME, MAE, RMSE))"""
    banded = f"""{{0}}, {DEM}, {BANDS},
b AS (
  SELECT p.*, altitude, bin_min, bin_max FROM p LEFT JOIN dem USING (iy, ix)
  LEFT JOIN bands ON altitude >= bin_min AND altitude < bin_max)"""
    sql["band_bias_monthly"] = f"""{banded.format(sides('monthly'))}
SELECT member, bin_min, bin_max, {SCORES} FROM b WHERE bin_min IS NOT NULL GROUP BY ALL"""
    sql["band_and_domain_bias"] = f"""{banded.format(sides('seasonal'))},
s AS (
  SELECT CAST(NULL AS DOUBLE) AS bin_min, CAST(NULL AS DOUBLE) AS bin_max, {SCORES} FROM b
  UNION ALL
  SELECT bin_min, bin_max, {SCORES} FROM b WHERE bin_min IS NOT NULL GROUP BY ALL)
SELECT bin_min, bin_max, metric, score FROM s UNPIVOT (score FOR metric IN (ME, MAE, RMSE))"""
    sql["band_cells"] = f"""WITH {M}, {DEM}, {BANDS},
a AS ({summed('m', 'daily', 'member, iy, ix')})
SELECT bin_min, bin_max, count(DISTINCT (iy, ix)) AS n_cells, count(value) AS n_values,
       sum(value) AS total
FROM a JOIN dem USING (iy, ix) JOIN bands ON altitude >= bin_min AND altitude < bin_max
GROUP BY bin_min, bin_max"""

    # maps
    sql["time_sum_map"] = f"WITH {M} SELECT member, iy, ix, sum(value) AS value FROM m GROUP BY ALL"
    sql["time_mean_map"] = f"""WITH {H}
SELECT member, iy, ix, {r('avg(value)', 'value')} FROM h GROUP BY ALL"""
    sql["map_difference"] = f"""WITH {ER},
a AS (SELECT member, iy, ix, sum(value) AS value FROM e GROUP BY ALL),
b AS (SELECT iy, ix, sum(value) AS value FROM r GROUP BY ALL)
SELECT member, iy, ix, {r('a.value - b.value', 'value')} FROM a JOIN b USING (iy, ix)"""
    sql["member_panels"] = f"{sides('monthly')} SELECT member, iy, ix, {MAE} AS score FROM p GROUP BY ALL"
    sql["single_map"] = f"""WITH {ER},
ea AS ({summed('e', 'monthly', 'member, iy, ix')}),
mean AS (SELECT time, iy, ix, avg(value) AS value FROM ea GROUP BY ALL),
ra AS ({summed('r', 'monthly', 'iy, ix')}),
p AS (SELECT iy, ix, mean.value - ra.value AS d FROM mean JOIN ra USING (time, iy, ix))
SELECT iy, ix, {RMSE} AS score FROM p GROUP BY ALL"""
    sql["band_panels"] = f"""{banded.format(sides('monthly'))},
s AS (
  SELECT member, iy, ix, bin_min, bin_max, avg(abs(d)) AS mae FROM b
  WHERE bin_min IS NOT NULL GROUP BY ALL)
SELECT bin_min, bin_max, iy, ix, {r('avg(mae)', 'MAE')} FROM s GROUP BY ALL"""

    # series and cycles
    daily = f"""WITH {M},
a AS ({summed('m', 'daily', 'member, iy, ix')}),
s AS (SELECT time, member, avg(value) AS value FROM a GROUP BY ALL)"""
    sql["area_mean_series"] = f"{daily} SELECT {text('time')}, member, {r('value', 'value')} FROM s"
    sql["grid_row_series"] = f"""WITH {M},
a AS ({summed('m', 'monthly', 'member, iy, ix')})
SELECT {text('time')}, member, iy, {r('avg(value)', 'value')} FROM a GROUP BY ALL"""
    sql["series_trend"] = f"""WITH {M},
a AS ({summed('m', 'monthly', 'member, iy, ix')}),
s AS (
  SELECT time, member, avg(value) AS value, datediff('day', DATE '1970-01-01', time) AS day
  FROM a GROUP BY ALL),
f AS (
  SELECT member, regr_slope(value, day) AS slope, regr_intercept(value, day) AS intercept
  FROM s GROUP BY ALL HAVING count(*) >= 2)
SELECT {text('time')}, member, {r('value', 'value')}, {r('slope * day + intercept', 'trend')}
FROM s LEFT JOIN f USING (member)"""
    sql["cycle_diurnal"] = f"""WITH {H},
s AS (SELECT date_trunc('hour', time) AS time, member, avg(value) AS value FROM h GROUP BY ALL)
SELECT member, CAST(hour(time) AS INT) AS hour, {r('avg(value)', 'value')} FROM s GROUP BY ALL"""
    steps = {
        "daily": "CAST(dayofyear(time) AS INT) AS dayofyear",
        "monthly": "CAST(month(time) AS INT) AS month",
        "seasonal": f"{SEASON} AS season",
        "annual": "CAST(year(time) AS INT) AS year",
    }
    for cycle, step in steps.items():
        sql[f"cycle_{cycle}"] = f"{daily} SELECT member, {step}, {r('avg(value)', 'value')} FROM s GROUP BY ALL"
    sql["spec_lines"] = f"""{line_rows('monthly')}
SELECT line, source, member, count(*) AS n_rows, {r('sum(value)', 'total')} FROM lv GROUP BY ALL"""
    sql["line_series"] = f"""{line_rows('monthly')},
s AS (
  SELECT line, source, member, time, avg(value) AS value,
         datediff('day', DATE '1970-01-01', time) AS day FROM lv GROUP BY ALL),
f AS (
  SELECT line, regr_slope(value, day) AS slope, regr_intercept(value, day) AS intercept
  FROM s GROUP BY ALL HAVING count(*) >= 2)
SELECT line, source, member, {text('time')}, {r('value', 'value')},
       {r('slope * day + intercept', 'trend')}
FROM s LEFT JOIN f USING (line)"""
    sql["line_cycle"] = f"""{line_rows('monthly', '-')},
s AS (SELECT line, source, member, time, avg(value) AS value FROM lv GROUP BY ALL)
SELECT line, source, member, CAST(month(time) AS INT) AS month, {r('avg(value)', 'value')}
FROM s GROUP BY ALL"""

    # distributions
    sql["hist_by_band"] = f"{BANDED},\n{histogram('bv', 'bin_min, bin_max', 30)}"
    sql["hist_by_cell"] = f"WITH {H},\n{histogram('h', 'iy, ix', 10)}"
    sql["hist_all"] = f"WITH {H},\n{histogram('h', '', 50)}"
    sql["kde_by_band"] = f"{BANDED},\n{density('bv', 'bin_min, bin_max')}"
    sql["kde_by_member"] = f"WITH {H},\n{density('h', 'member')}"
    sql["line_histograms"] = f"{line_rows('monthly')},\n{histogram('lv', 'line, source', 20)}"
    sql["line_densities"] = f"{line_rows('yearly')},\n{density('lv', 'line, source')}"

    # runs
    sql["preprocess"] = f"""WITH {ER}
SELECT {text(DAY)}, member, iy, ix, {r('sum(value)', 'value')} FROM e GROUP BY ALL
UNION ALL
SELECT {text(DAY)}, 'reference', iy, ix, {r('value * 0.1e0', 'value')} FROM r"""
    shifted = cells("shifted", "46.15e0", "10.125e0")

    def regridded(period: str, value: str) -> str:
        label = LABELS[period][0]
        return f"""WITH {ER}, {cells()}, {shifted},
{both_maps('cells', 'shifted')},
ea AS ({summed('e', period, 'member, iy, ix', value=value)}),
eg AS (
  SELECT {label}, member, t_iy AS iy, t_ix AS ix, CASE WHEN in_iy AND in_ix THEN value ELSE 0 END AS value
  FROM ea JOIN ymap USING (iy) JOIN xmap USING (ix)),
ra AS ({summed('r', period, 'iy, ix', value=value)}),
p AS (
  SELECT {label}, member, iy, ix, eg.value - ra.value AS d FROM eg JOIN ra USING ({label}, iy, ix))"""

    sql["minimal_run"] = f"""{regridded('daily', 'value')}
SELECT member, iy, ix, {RMSE} AS RMSE FROM p GROUP BY ALL"""
    sql["verification_run"] = f"""{banded.format(regridded('monthly', 'nullif(value, 50)'))},
s AS (
  SELECT member, CAST(NULL AS DOUBLE) AS bin_min, CAST(NULL AS DOUBLE) AS bin_max, {SCORES}
  FROM b GROUP BY ALL
  UNION ALL
  SELECT member, bin_min, bin_max, {SCORES} FROM b WHERE bin_min IS NOT NULL GROUP BY ALL)
SELECT member, bin_min, bin_max, metric, score FROM s UNPIVOT (score FOR metric IN (ME, MAE, RMSE))"""
    sql["temperature_run"] = f"""WITH {ER},
ea AS ({summed('e', 'daily', 'member, iy, ix', 'mean', '(value - 273.15e0)')}),
ra AS ({summed('r', 'daily', 'iy, ix', 'mean')}),
p AS (SELECT member, ea.value - ra.value AS d FROM ea JOIN ra USING (time, iy, ix)),
s AS (SELECT member, {ME} AS ME, {RMSE} AS RMSE FROM p GROUP BY ALL)
SELECT member, metric, score FROM s UNPIVOT (score FOR metric IN (ME, RMSE))"""
    box = "lat BETWEEN 46.25 AND 1e9 AND lon BETWEEN 10.25 AND 12"
    kept = "CASE WHEN value >= 10 AND value < 40 THEN value END"
    sql["full_run"] = f"""WITH {ER}, {W}, {DEM}, {BANDS}, {cells('all_cells')},
{cells('all_shifted', '46.15e0', '10.125e0')},
cells AS (SELECT * FROM all_cells WHERE {box}), shifted AS (SELECT * FROM all_shifted WHERE {box}),
{both_maps('cells', 'shifted')},
days AS ({INCLUDED}),
e1 AS (
  SELECT time, iy, ix, avg(nullif(value, 50)) AS value FROM e SEMI JOIN cells USING (iy, ix)
  WHERE member IN ('02', '05', '07') AND {TIMES} AND {DAY} IN (FROM days) GROUP BY ALL),
e2 AS (SELECT time, iy, ix, {kept} AS value FROM e1),
r2 AS (
  SELECT time, iy, ix, {kept.replace('value', 'nullif(value, 50)')} AS value
  FROM r SEMI JOIN shifted USING (iy, ix) WHERE {TIMES} AND {DAY} IN (FROM days)),
ea AS ({summed('e2', 'yearly', 'iy, ix')}),
eg AS (
  SELECT time, t_iy AS iy, t_ix AS ix, CASE WHEN in_iy AND in_ix THEN value ELSE 0 END AS value
  FROM ea JOIN ymap USING (iy) JOIN xmap USING (ix)),
ra AS ({summed('r2', 'yearly', 'iy, ix')}),
b AS (
  SELECT iy, ix, bin_min, bin_max, eg.value - ra.value AS d
  FROM eg JOIN ra USING (time, iy, ix) LEFT JOIN dem USING (iy, ix)
  LEFT JOIN bands ON altitude >= bin_min AND altitude < bin_max),
s AS (
  SELECT iy, ix, CAST(NULL AS DOUBLE) AS bin_min, CAST(NULL AS DOUBLE) AS bin_max, {SCORES}
  FROM b GROUP BY ALL
  UNION ALL
  SELECT iy, ix, bin_min, bin_max, {SCORES} FROM b WHERE bin_min IS NOT NULL GROUP BY ALL)
SELECT iy, ix, bin_min, bin_max, metric, score FROM s UNPIVOT (score FOR metric IN (ME, MAE, RMSE))"""
    sql["band_rmse_maps"] = f"""WITH {ER}, {DEM}, {BANDS},
e1 AS (SELECT time, iy, ix, avg(value) AS value FROM e GROUP BY ALL),
ea AS ({summed('e1', 'daily', 'iy, ix')}),
ra AS ({summed('r', 'daily', 'iy, ix')}),
p AS (SELECT time, iy, ix, ea.value - ra.value AS d FROM ea JOIN ra USING (time, iy, ix)),
s AS (SELECT iy, ix, {RMSE} AS RMSE FROM p GROUP BY ALL)
SELECT iy, ix, RMSE, bin_min, bin_max FROM s JOIN dem USING (iy, ix)
JOIN bands ON altitude >= bin_min AND altitude < bin_max"""

    # figures
    sql["figure_spatial_map"] = sql["single_map"]
    sql["figure_cycle"] = sql["line_cycle"]
    sql["figure_member_subplots"] = sql["member_panels"]
    sql["figure_altitude_bin_subplots"] = sql["band_panels"]
    spec = ", ".join(
        f"('ens_{name.replace(chr(39), chr(39) * 2)}_{low}-{high}', 'ensemble', '{kind}', {low}e0, {high}e0)"
        for low, high in ((0, 2000), (1000, 6000))
        for kind, name in (("all", "all"), ("two", "['02', '05']"))
    )
    spec += ", ('ref_na_0-2000', 'reference', NULL, 0e0, 2000e0), ('ref_na_1000-6000', 'reference', NULL, 1000e0, 6000e0)"
    chosen = f"""WITH {ER}, {DEM}, spec AS (SELECT * FROM (VALUES {spec}) AS v(line, source, choice, lo, hi)),
ea AS ({summed('e', 'monthly', 'member, iy, ix')}),
ra AS ({summed('r', 'monthly', 'iy, ix')}),
lv AS (
  SELECT line, source, time, member, iy, ix, value FROM ea JOIN dem USING (iy, ix)
  JOIN spec ON choice = 'all' OR choice = 'two' AND member IN ('02', '05')
  WHERE source = 'ensemble' AND altitude >= lo AND altitude < hi
  UNION ALL
  SELECT line, source, time, NULL, iy, ix, value FROM ra JOIN dem USING (iy, ix)
  JOIN spec ON source = 'reference' WHERE altitude >= lo AND altitude < hi)"""
    sql["figure_time_series"] = f"""{chosen},
s AS (
  SELECT line, source, member, time, avg(value) AS value,
         datediff('day', DATE '1970-01-01', time) AS day FROM lv GROUP BY ALL),
f AS (
  SELECT line, member, regr_slope(value, day) AS slope, regr_intercept(value, day) AS intercept
  FROM s GROUP BY ALL HAVING count(*) >= 2)
SELECT s.line, source, s.member, {text('time')}, {r('value', 'value')},
       {r('slope * day + intercept', 'trend')}
FROM s LEFT JOIN f ON s.line = f.line AND s.member IS NOT DISTINCT FROM f.member"""
    sql["figure_distribution"] = f"""{chosen},
cm AS (SELECT line, source, member, iy, ix, avg(value) AS value FROM lv GROUP BY ALL),
{histogram('cm', 'line, source', 20)}"""
    sql["banded_data"] = f"""{banded.format(sides('monthly'))},
mp AS (SELECT member, iy, ix, bin_min, bin_max, avg(abs(d)) AS value FROM b GROUP BY ALL),
parts AS (
  SELECT 'ensemble' AS part, iy, ix, value FROM ea
  UNION ALL SELECT 'reference', iy, ix, value FROM ra
  UNION ALL SELECT 'maps', iy, ix, value FROM mp)
SELECT part, bin_min, bin_max, count(*) AS n_rows, {r('sum(value)', 'total')}
FROM parts JOIN dem USING (iy, ix) JOIN bands ON altitude >= bin_min AND altitude < bin_max
GROUP BY ALL"""

    # saved tables
    sql["saved_months"] = sql["time_slice"]
    sql["saved_months_open"] = f"""WITH {M}
SELECT year(time) AS year, month(time) AS month, member, count(value) AS n_values, {r('sum(value)', 'total')}
FROM m WHERE time < TIMESTAMP '2001-06-16' GROUP BY ALL"""
    sql["saved_scores"] = f"""{sides('daily')}, s AS (SELECT member, {SCORES} FROM p GROUP BY ALL)
SELECT member, metric, score FROM s UNPIVOT (score FOR metric IN (ME, MAE, RMSE))"""
    sql["weather_csv"] = f"WITH {W} SELECT {text('time')}, slwt FROM w"
    sql["saved_cells_bias"] = sql["bias_rmse_map"]
    sql["configured_run"] = f"""WITH {ER}, {W}, {DEM}, {BANDS}, days AS ({INCLUDED}),
e1 AS (SELECT * FROM e WHERE member IN ('02', '05', '07') AND {TIMES} AND {DAY} IN (FROM days)),
r1 AS (SELECT * FROM r WHERE {TIMES} AND {DAY} IN (FROM days)),
ea AS ({summed('e1', 'monthly', 'member, iy, ix', value='nullif(value, 50)')}),
ra AS ({summed('r1', 'monthly', 'iy, ix', value='nullif(value, 50)')}),
b AS (
  SELECT member, bin_min, bin_max, ea.value - ra.value AS d FROM ea JOIN ra USING (time, iy, ix)
  LEFT JOIN dem USING (iy, ix) LEFT JOIN bands ON altitude >= bin_min AND altitude < bin_max),
s AS (
  SELECT member, CAST(NULL AS DOUBLE) AS bin_min, CAST(NULL AS DOUBLE) AS bin_max, {SCORES}
  FROM b GROUP BY ALL
  UNION ALL
  SELECT member, bin_min, bin_max, {SCORES} FROM b WHERE bin_min IS NOT NULL GROUP BY ALL)
SELECT member, bin_min, bin_max, metric, score FROM s UNPIVOT (score FOR metric IN (ME, MAE, RMSE))"""
    return sql
