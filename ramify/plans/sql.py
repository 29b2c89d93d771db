"""DuckDB SQL of the registered queries, built from common table expressions."""

from __future__ import annotations

import re

from ..config import DEFAULT, REPORTING, SCORING, Conformal, Schedule

_DEMAND = """
demand AS (
    SELECT CAST(l_shipdate AS DATE) AS day, r_name AS borough, n_name AS area, sum(l_quantity) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
), bounds AS (
    SELECT min(day) AS lo, max(day) AS hi, date_diff('day', min(day), max(day)) + 1 AS n_days FROM demand
), leaves AS (
    SELECT area, date_diff('day', min(day), max(day)) + 1 AS span, sum(n) / any_value(n_days) AS per_day,
           date_diff('day', min(day), max(day)) + 1 >= 0.98 * any_value(n_days) AND sum(n) / any_value(n_days) >= 1 AS kept
    FROM demand, bounds GROUP BY area
), paths AS (SELECT DISTINCT borough, area FROM demand JOIN leaves USING (area) WHERE kept
), days AS (
    SELECT (lo + CAST(i AS INTEGER)) AS day, CAST(i AS INTEGER) AS day_idx FROM bounds, generate_series(0, 20000) t(i) WHERE i < n_days
), grid AS (
    SELECT d.day, d.day_idx, p.borough, p.area, coalesce(f.n, 0.0) AS n
    FROM days d CROSS JOIN paths p LEFT JOIN demand f ON f.day = d.day AND f.area = p.area
), panel AS (
    SELECT CASE WHEN borough IS NULL THEN 'ALL' WHEN area IS NULL THEN 'ALL/' || borough ELSE 'ALL/' || borough || '/' || area END AS node,
           CASE WHEN borough IS NULL THEN 'city' WHEN area IS NULL THEN 'borough' ELSE 'area' END AS level, day, day_idx, sum(n) AS value
    FROM grid GROUP BY GROUPING SETS ((day, day_idx), (day, day_idx, borough), (day, day_idx, borough, area))
)"""


def _schedule(s: Schedule) -> str:
    return f""", origins AS (
    SELECT CAST(i AS INTEGER) AS origin, CAST({s.min_train - 1} + i * {s.step} AS INTEGER) AS origin_idx,
           CAST(greatest({s.min_train} + i * {s.step} - {s.train_window}, 0) AS INTEGER) AS train_from,
           i % {s.refit_every} = 0 AS refit, CAST(i - i % {s.refit_every} AS INTEGER) AS refit_origin
    FROM bounds, generate_series(0, 5000) t(i) WHERE {s.min_train - 1} + i * {s.step} + {s.horizon} < n_days
), actuals AS (
    SELECT o.origin, p.node, p.level, CAST(t.step AS INTEGER) AS step, p.value AS y
    FROM origins o, generate_series(1, {s.horizon}) t(step), panel p WHERE p.day_idx = o.origin_idx + t.step
), points AS (
    SELECT o.origin, p.node, p.level, CAST(t.step AS INTEGER) AS step, p.value AS point
    FROM origins o, generate_series(1, {s.horizon}) t(step), panel p
    WHERE p.day_idx = o.origin_idx + 1 - 7 * ((t.step + 6) // 7) + (t.step - 1) % 7
), copied AS (SELECT p.*, a.y FROM points p JOIN actuals a USING (origin, node, step)
), copy_errors AS (SELECT level, origin, avg(abs(y - point)) AS score FROM copied GROUP BY ALL
), mean_points AS (
    SELECT o.origin, p.node, p.level, CAST(t.step AS INTEGER) AS step, avg(p.value) AS point
    FROM origins o, generate_series(1, {s.horizon}) t(step), generate_series(0, 3) w(k), panel p
    WHERE p.day_idx = o.origin_idx + t.step - 7 * ((t.step + 6) // 7 + w.k) GROUP BY ALL
), mean_errors AS (
    SELECT p.level, origin, avg(abs(y - point)) AS score FROM mean_points p JOIN actuals USING (origin, node, step) GROUP BY ALL
)"""


def _windowed(source: str, known: str, split: str, predictive: str) -> str:
    """Known scores and errors of the rows ``source``, and the intervals and distributions made from them, under the given names."""
    picks = [min(max(-int(-round(53 * q, 9) // 1), 1), 52) for q in REPORTING]
    return f""", {known}_scored AS (
    SELECT *, abs(y - point) AS score, CASE WHEN step <= 7 THEN 1 ELSE 2 END AS lag FROM {source}
), {known} AS (
    SELECT *, list(score) OVER w AS s, list(y - point) OVER w AS e FROM {known}_scored WHERE lag = 1
    WINDOW w AS (PARTITION BY node, step ORDER BY origin ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)
    UNION ALL
    SELECT *, list(score) OVER w, list(y - point) OVER w FROM {known}_scored WHERE lag = 2
    WINDOW w AS (PARTITION BY node, step ORDER BY origin ROWS BETWEEN 53 PRECEDING AND 2 PRECEDING)
), {known}_halves AS (
    SELECT *, CASE WHEN len(s) > 0 THEN list_sort(s)[least(CAST(ceil((len(s) + 1) * (1 - 0.1)) AS INTEGER), len(s))] END AS half FROM {known}
), {split} AS (
    SELECT origin, node, level, step, y, half, CASE WHEN half IS NOT NULL THEN greatest(point - half, 0) END AS low, point + half AS high,
           CASE WHEN half IS NOT NULL THEN y >= greatest(point - half, 0) AND y <= point + half END AS hit FROM {known}_halves
), {predictive} AS (
    SELECT origin, node, level, step, y, list_transform({picks}, lambda k: greatest(point + list_sort(e)[k], 0)) AS q
    FROM {known} WHERE origin >= 53 AND len(e) = 52
)"""


_WINDOWED = _windowed("copied", "known", "split", "predictive")


def _naive(levels) -> str:
    grid = "[" + ", ".join(map(repr, levels)) + "]"
    return f""", differences AS (
    SELECT x.node, x.day_idx, CAST(7 * k AS INTEGER) AS lag, o.day_idx AS old_idx, x.value - o.value AS d
    FROM panel x, generate_series(1, 2) t(k), panel o WHERE o.node = x.node AND o.day_idx = x.day_idx - 7 * k
), residuals AS (
    SELECT origin, node, lag, quantile_cont(d, {grid}) AS residuals FROM origins JOIN differences
    ON day_idx <= origin_idx AND old_idx >= train_from GROUP BY ALL
), naive AS (
    SELECT origin, node, step, level, list_transform(residuals, lambda r: greatest(point + r, 0)) AS q
    FROM points JOIN residuals USING (origin, node) WHERE lag = 7 * ((step + 6) // 7)
)""" + _scored("naive n JOIN actuals USING (origin, node, step)", "scored", levels, "n.*, y")


def _scored(source: str, name: str, levels, columns: str = "*") -> str:
    """Losses, absolute error and CRPS of rows that have ``q`` on the levels and ``y``."""
    grid = "[" + ", ".join(map(repr, levels)) + "]"
    n = len(levels)
    weights = "[" + ", ".join(repr((levels[min(k + 1, n - 1)] - levels[max(k - 1, 0)]) / 2) for k in range(n)) + "]"
    a, b = levels[0], levels[-1]
    return f""", {name}_lossy AS (
    SELECT {columns}, list_transform(generate_series(1, {n}), lambda i: greatest({grid}[i] * (y - q[i]), ({grid}[i] - 1) * (y - q[i]))) AS losses
    FROM {source}
), {name} AS (
    SELECT *, abs(y - q[{levels.index(0.5) + 1}]) AS abs_error,
           2 * (list_sum(list_transform(generate_series(1, {n}), lambda i: losses[i] * {weights}[i]))
           + CASE WHEN y >= q[1] THEN {a} * {a} / 2 * (y - q[1]) ELSE ({a} - {a} * {a} / 2) * (q[1] - y) END
           + CASE WHEN y >= q[{n}] THEN (1 - {b} * {b}) / 2 * (y - q[{n}]) ELSE (1 - {b}) * (1 - {b}) / 2 * (q[{n}] - y) END) AS crps
    FROM {name}_lossy
)"""


def of(select: str) -> str:
    """Over the default schedule with points, actuals and conformal windows."""
    return f"WITH {_DEMAND}{_schedule(DEFAULT)}{_WINDOWED} {select}"


def adaptive(select: str) -> str:
    """Over the default schedule with the adaptive level of every series and step size; recursion goes from origin to origin."""
    gammas = ", ".join(f"({g!r})" for g in Conformal().gammas)
    pick = "list_sort({0})[least(greatest(CAST(ceil((len({0}) + 1) * (1 - {1})) AS INTEGER), 1), len({0}))]"
    return f"""WITH RECURSIVE {_DEMAND}{_schedule(DEFAULT)}{_WINDOWED}, seq AS MATERIALIZED (
    SELECT node, step, origin, score, lag, list(score) OVER (PARTITION BY node, step ORDER BY origin ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS before,
           list(score) OVER (PARTITION BY node, step ORDER BY origin ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS upto FROM known_scored
), moved AS (
    SELECT g.gamma::DOUBLE AS gamma, node, step, origin, 0.1::DOUBLE AS alpha FROM seq, (VALUES {gammas}) g(gamma) WHERE origin = 0
    UNION ALL
    SELECT m.gamma, s.node, s.step, s.origin,
           least(greatest(m.alpha + m.gamma * (0.1::DOUBLE - (s.score > {pick.format("s.before", "m.alpha")})::INTEGER), 0.0001::DOUBLE), (1 - 0.0001)::DOUBLE)
    FROM moved m JOIN seq s ON s.node = m.node AND s.step = m.step AND s.origin = m.origin + 1
), widths AS (
    SELECT gamma, node, step, CAST(origin + lag AS INTEGER) AS origin, {pick.format("upto", "alpha")} AS half FROM moved JOIN seq USING (node, step, origin)
) {select}"""


def two_models(select: str) -> str:
    """Over the default schedule with scores of the weekday mean and of the copied week, both by their conformal distributions."""
    mean = ", averaged AS (SELECT p.*, a.y FROM mean_points p JOIN actuals a USING (origin, node, step))" + _windowed("averaged", "mean_known", "mean_split", "mean_predictive")
    scored = _scored("mean_predictive", "mean_scores", REPORTING) + _scored("predictive", "copy_scores", REPORTING)
    return f"WITH {_DEMAND}{_schedule(DEFAULT)}{_WINDOWED}{mean}{scored} {select}"


def reported(select: str) -> str:
    """Over the default schedule with naive quantiles on the reporting levels."""
    return f"WITH {_DEMAND}{_schedule(DEFAULT)}{_naive(REPORTING)} {select}"


def routed(select: str) -> str:
    """Over the default schedule with conformal distributions and naive quantiles, both on the reporting levels."""
    steps = f"WITH {_DEMAND}{_schedule(DEFAULT)}{_WINDOWED}{_naive(REPORTING)} {select}"
    for name in ("demand", "panel", "origins", "points", "actuals", "copied", "known", "residuals"):  # read more than once, or costly
        steps = re.sub(rf"(?<=[\s,]){name} AS \(", f"{name} AS MATERIALIZED (", steps)
    return steps


def full(select: str) -> str:
    """Over the default schedule with naive quantiles on the scoring levels."""
    return f"WITH {_DEMAND}{_schedule(DEFAULT)}{_naive(SCORING)} {select}"


_RAW = """raw AS (
    SELECT CAST(l_shipdate AS DATE) AS day, r_name AS borough, c.n_name AS area, sum(l_quantity) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN region ON s.n_regionkey = r_regionkey GROUP BY ALL
), assigned AS (
    SELECT area, borough FROM (SELECT area, borough, row_number() OVER (PARTITION BY area ORDER BY sum(n) DESC, borough) AS k FROM raw GROUP BY area, borough) WHERE k = 1
)"""


def raw(select: str) -> str:
    """Over counts in which areas meet several boroughs."""
    return f"WITH {_RAW} {select}"


EVENTS_DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
YEAR_WINDOWS = """
SELECT CAST(y AS INTEGER) AS year, greatest(make_date(CAST(y AS INTEGER), 1, 1), DATE '1995-01-02') AS lo,
       least(make_date(CAST(y + 1 AS INTEGER), 1, 1), DATE '2001-11-05') AS hi FROM generate_series(1995, 2001) t(y)"""
TIDY = raw("SELECT day, borough, area, CAST(n AS BIGINT) AS n FROM raw")
DISAGREEMENT = raw("""
, joined AS (SELECT r.*, a.borough AS assigned FROM raw r JOIN assigned a USING (area)), totals AS (
    SELECT sum(n) AS total, round(sum(CASE WHEN borough <> assigned THEN n ELSE 0 END) / sum(n), 6) AS share FROM joined
) SELECT area, assigned, moved, total, share FROM (
    SELECT area, assigned, sum(n) AS moved FROM joined WHERE borough <> assigned GROUP BY ALL ORDER BY moved DESC, area LIMIT 10
), totals""")
COVERAGE = of("""
SELECT area, min(day) AS first, max(day) AS last, count(DISTINCT day) AS active_days, sum(n) AS n, round(count(DISTINCT day) / any_value(n_days), 6) AS share
FROM demand, bounds GROUP BY area""")
OUTLIERS = of("""
, daily AS (SELECT day, sum(n) AS value FROM demand GROUP BY day),
centre AS (SELECT quantile_cont(value, 0.5) AS med, stddev_pop(value) AS dev FROM daily),
scale AS (SELECT any_value(med) AS med, CASE WHEN median(abs(value - med)) > 0 THEN 1.4826 * median(abs(value - med)) ELSE nullif(any_value(dev), 0) END AS s FROM daily, centre)
SELECT day, value, round((value - med) / s, 6) AS z FROM daily, scale WHERE abs((value - med) / s) > 2""")
PIVOT = of("""SELECT day, coalesce(sum(n) FILTER (borough = 'AFRICA'), 0) AS "AFRICA", coalesce(sum(n) FILTER (borough = 'AMERICA'), 0) AS "AMERICA",
coalesce(sum(n) FILTER (borough = 'ASIA'), 0) AS "ASIA", coalesce(sum(n) FILTER (borough = 'EUROPE'), 0) AS "EUROPE",
coalesce(sum(n) FILTER (borough = 'MIDDLE EAST'), 0) AS "MIDDLE EAST" FROM demand GROUP BY day""")
_NODES = """named AS (
    SELECT DISTINCT node, level, CASE level WHEN 'city' THEN 0 WHEN 'borough' THEN 1 ELSE 2 END AS rank FROM panel
), ordered AS (SELECT node, level, CAST(row_number() OVER (ORDER BY rank, node) - 1 AS INTEGER) AS node_ord FROM named)"""
NODES = of(f", {_NODES} SELECT node, level, node_ord FROM ordered")


def _nth(name: str, month: int, weekday: int, n: int) -> str:
    if n > 0:
        first = f"make_date(y, {month}, 1)"
        return f"SELECT '{name}' AS holiday, {first} + CAST(({weekday} - (isodow({first}) - 1) + 7) % 7 + {7 * (n - 1)} AS INTEGER) AS day, y FROM years"
    last = f"last_day(make_date(y, {month}, 1))"
    return f"SELECT '{name}', {last} - CAST((isodow({last}) - 1 - {weekday} + 7) % 7 AS INTEGER), y FROM years"


def _holidays(lo: int, hi: int) -> str:
    from ..functions.calendar import DATED, RULED

    rows = [_nth(*r) for r in RULED] + [f"SELECT '{n}', make_date(y, {m}, {d}), y FROM years" for n, m, d in DATED]
    rows.append("SELECT 'juneteenth', make_date(y, 6, 19), y FROM years WHERE y >= 2021")
    return f"""years AS (SELECT CAST(i AS INTEGER) AS y FROM generate_series({lo}, {hi}) t(i)), plain AS ({" UNION ALL ".join(rows)}), holidays AS (
    SELECT CAST(day AS DATE) AS day, holiday, CAST(CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END AS DATE) AS observed FROM plain
)"""


HOLIDAYS = "WITH " + _holidays(1995, 2026)
_CALENDAR = """SELECT d.day, isodow(d.day) - 1 AS dow, isodow(d.day) >= 6 AS is_weekend, h.holiday, h.holiday IS NOT NULL AS is_holiday,
       d.day IN (SELECT observed FROM holidays) AS is_holiday_observed FROM days d LEFT JOIN holidays h ON h.day = d.day"""
CALENDAR = of(f", {_holidays(1995, 2001)} {_CALENDAR}")
DESIGN = of(f"""
, {_NODES}, {_holidays(1995, 2001)}, ahead AS (SELECT (lo + CAST(i AS INTEGER)) AS day, CAST(i AS INTEGER) AS day_idx FROM bounds, generate_series(0, 20000) t(i) WHERE i < n_days + 14),
calendar AS ({_CALENDAR.replace("FROM days d", "FROM ahead d")}),
anchors AS (SELECT node, level, a.day_idx FROM ordered, days a WHERE a.day_idx >= 90),
stepped AS (SELECT a.*, CAST(t.step AS INTEGER) AS step, CAST((t.step + 6) // 7 AS INTEGER) AS w FROM anchors a, generate_series(1, 14) t(step)),
history AS (SELECT node, day_idx, value, list(value) OVER (PARTITION BY node ORDER BY day_idx ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) AS h FROM panel)
SELECT s.node, s.level, s.day_idx, CAST(s.day_idx + step AS INTEGER) AS target_idx, step, node_ord AS series,
       CASE s.level WHEN 'city' THEN 0 WHEN 'borough' THEN 1 ELSE 2 END AS level_code,
       h[91 + step - 7 * w] AS same_weekday_1, h[91 + step - 7 * (w + 1)] AS same_weekday_2, h[91 + step - 7 * (w + 2)] AS same_weekday_3, h[91 + step - 7 * (w + 3)] AS same_weekday_4,
       h[91] AS recent_0, h[90] AS recent_1, h[85] AS recent_6, h[78] AS recent_13,
       round(list_avg(h[85:91]), 6) AS mean_7, round(list_avg(h[64:91]), 6) AS mean_28, round(list_avg(h), 6) AS mean_91,
       c.dow, dayofyear(c.day) AS day_of_year, c.is_holiday::INTEGER AS is_holiday, c.is_holiday_observed::INTEGER AS is_holiday_observed
FROM stepped s JOIN history x ON x.node = s.node AND x.day_idx = s.day_idx JOIN ordered o ON o.node = s.node
JOIN ahead d ON d.day_idx = s.day_idx + step JOIN calendar c ON c.day = d.day""")
STAFFING = of("""
, levels(service_level) AS (VALUES (0.8), (0.9), (0.95)), needs AS (
    SELECT origin, step, CAST(service_level AS DOUBLE) AS service_level, ceil(greatest(y, 0) / 10.0 - 1e-9) AS need,
           ceil(greatest(CASE service_level WHEN 0.8 THEN q[7] + (0.8 - 0.75) / (0.9 - 0.75) * (q[8] - q[7]) WHEN 0.9 THEN q[8] ELSE q[9] END, 0) / 10.0 - 1e-9) AS units
    FROM predictive, levels WHERE level = 'area'
), daily AS (
    SELECT origin, step, service_level, sum(units) AS units, sum(need) AS oracle_units, sum(greatest(units - need, 0) + 4 * greatest(need - units, 0)) AS cost
    FROM needs GROUP BY ALL
) SELECT 'copy' AS model, service_level, origin, round(avg(units), 6) AS units, round(avg(oracle_units), 6) AS oracle_units, round(avg(cost), 6) AS cost FROM daily GROUP BY ALL""")
BOOTSTRAP = of("""
, size AS (SELECT count(*) AS n, CAST(ceil(count(*) / 28.0) AS INTEGER) AS blocks FROM origins), starts AS (
    SELECT r, k, (r * 7919 + k * 104729 + 12345) % (n - 28 + 1) AS lo, CASE WHEN k = blocks - 1 THEN n - 28 * (blocks - 1) ELSE 28 END AS len
    FROM size, generate_series(0, 1999) a(r), generate_series(0, 100) b(k) WHERE k < blocks
), means AS (SELECT level, r, avg(score) AS m FROM starts JOIN copy_errors ON origin >= lo AND origin < lo + len GROUP BY ALL)
SELECT level, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means GROUP BY level""")


def _blocks(n: str) -> str:
    """Bounds of the arithmetic blocks of 2000 resamples of ``n`` origins."""
    return f"""size AS (SELECT {n} AS n, CAST(ceil({n} / 28.0) AS INTEGER) AS blocks), starts AS (
    SELECT r, (r * 7919 + k * 104729 + 12345) % (n - 28 + 1) AS lo, CASE WHEN k = blocks - 1 THEN n - 28 * (blocks - 1) ELSE 28 END AS len
    FROM size, generate_series(0, 1999) a(r), generate_series(0, 100) b(k) WHERE k < blocks)"""


_AFTER_WINDOW = "(SELECT count(*) FROM origins WHERE origin >= 53)"
SKILL_TABLE = two_models(f"""
, {_blocks(_AFTER_WINDOW)}, both_models AS (
    SELECT level, origin, avg(m.crps) AS score, avg(m.losses[6]) AS mid, avg((m.y BETWEEN m.q[3] AND m.q[9])::INT) AS hit,
           sum((m.y BETWEEN m.q[3] AND m.q[9])::INT) AS hits, avg(m.q[9] - m.q[3]) AS width, avg(c.crps) AS base, avg(c.losses[6]) AS base_mid
    FROM mean_scores m JOIN copy_scores c USING (level, origin, node, step) GROUP BY ALL
), rolled AS (
    SELECT level, avg(hit) OVER w AS r, count(*) OVER w AS n FROM both_models WINDOW w AS (PARTITION BY level ORDER BY origin ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
), drawn AS (
    SELECT level, r, 1 - avg(score) / avg(base) AS skill FROM starts JOIN both_models ON origin - 53 >= lo AND origin - 53 < lo + len GROUP BY ALL
), ends AS (SELECT level, quantile_cont(skill, 0.025) AS low, quantile_cont(skill, 0.975) AS high FROM drawn GROUP BY level)
SELECT 'mean' AS model, level, round(avg(score), 6) AS crps, round(1 - avg(score) / avg(base), 6) AS skill, round(1 - avg(mid) / avg(base_mid), 6) AS median_skill,
       round(avg(hit), 6) AS coverage, round(avg(width), 6) AS width, count(*) AS origins,
       (SELECT round(min(r), 6) FROM rolled x WHERE x.level = b.level AND n = 13) AS worst,
       (SELECT round(low, 6) FROM ends e WHERE e.level = b.level) AS low, (SELECT round(high, 6) FROM ends e WHERE e.level = b.level) AS high
FROM both_models b GROUP BY level""")
_STATISTICS = {"crps": "avg(score)", "skill": "1 - avg(score) / avg(base)", "median_skill": "1 - avg(mid) / avg(base_mid)", "coverage": "avg(hit)", "interval_width": "avg(width)"}


def _with_ends(source: str, keys: str, statistics: dict[str, str], first: int, nulls: dict[str, str] = {}, more: str = "") -> str:
    """Statistics of a series ``source`` (``origin`` from ``first``) with the ends over the drawn origins; ``nulls`` says where one has no value."""
    drawn = ", ".join(f"{e} AS {n}" for n, e in statistics.items())
    ends = ", ".join(f"quantile_cont({n}, 0.025) AS {n}_low, quantile_cont({n}, 0.975) AS {n}_high" for n in statistics)
    show = lambda n, e: f"CASE WHEN {nulls[n]} THEN round({e}, 6) END" if n in nulls else f"round({e}, 6)"
    shown = ", ".join(f"{show(n, n)} AS {n}, {show(n, n + '_low')} AS {n}_low, {show(n, n + '_high')} AS {n}_high" for n in statistics)
    return f"""drawn AS (SELECT {keys}, r, {drawn} FROM starts JOIN {source} ON origin - {first} >= lo AND origin - {first} < lo + len GROUP BY ALL
), ends AS (SELECT {keys}, {ends} FROM drawn GROUP BY ALL), whole AS (SELECT {keys}, count(*) AS origins, {drawn}{more} FROM {source} GROUP BY ALL)
SELECT {keys}, origins, {shown}"""


SKILL_ROWS = two_models(f"""
, {_blocks(_AFTER_WINDOW)}, of_both AS (SELECT 'mean' AS model, * FROM mean_scores UNION ALL SELECT 'copy', * FROM copy_scores), own AS (
    SELECT model, level, origin, avg(crps) AS score, avg(losses[6]) AS mid, avg((y BETWEEN q[3] AND q[9])::INT) AS hit, avg(q[9] - q[3]) AS width FROM of_both GROUP BY ALL
), series AS MATERIALIZED (
    SELECT o.*, b.score AS base, b.mid AS base_mid FROM own o JOIN own b ON b.model = 'copy' AND b.level = o.level AND b.origin = o.origin
), rolled AS (
    SELECT model, level, origin, round(avg(hit) OVER w, 9) AS v, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY model, level ORDER BY origin ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
), lowest AS (SELECT model, level, min(v) AS worst, arg_min(origin, (v, origin)) AS worst_at FROM rolled WHERE n = 13 GROUP BY ALL
), {_with_ends("series", "model, level", _STATISTICS, 53, dict.fromkeys(("skill", "median_skill"), "model <> 'copy'"))}, round(worst, 6) AS worst, d.day AS worst_day
FROM whole JOIN ends USING (model, level) JOIN lowest USING (model, level) JOIN origins o ON o.origin = worst_at JOIN days d ON d.day_idx = o.origin_idx""")


def _service_levels() -> str:
    """Service levels with the place on the reporting grid below each and the way to the next, as rows."""
    from ..operators.decision import DecisionInputs

    rows = []
    for wanted in DecisionInputs().slider_levels:
        k = next((i for i, own in enumerate(REPORTING) if abs(own - wanted) <= 1e-9), None)
        below = max(i for i, own in enumerate(REPORTING) if own < wanted) if k is None else k
        share = (wanted - REPORTING[below]) / (REPORTING[below + 1] - REPORTING[below]) if k is None else 0.0
        rows.append(f"({wanted!r}::DOUBLE, {below + 1}, {share!r}::DOUBLE)")
    return ", ".join(rows)


STAFFING_ROWS = two_models(f"""
, {_blocks(_AFTER_WINDOW)}, levels(service_level, k, share) AS (VALUES {_service_levels()}), forecasts AS (
    SELECT 'mean' AS model, origin, node, step, y, q FROM mean_predictive WHERE level = 'area' UNION ALL SELECT 'copy', origin, node, step, y, q FROM predictive WHERE level = 'area'
), needs AS (
    SELECT model, service_level, origin, step, ceil(greatest(y, 0) / 10.0::DOUBLE - 1e-9) AS need,
           ceil(greatest(q[k] + share * (q[k + 1] - q[k]), 0) / 10.0::DOUBLE - 1e-9) AS units FROM forecasts, levels
), daily AS (
    SELECT model, service_level, origin, step, sum(units) AS units, sum(need) AS needed, sum(greatest(units - need, 0) + 4 * greatest(need - units, 0)) AS cost FROM needs GROUP BY ALL
), own AS (SELECT model, service_level, origin, avg(units) AS staffed, avg(needed) AS needed, avg(cost) AS paid FROM daily GROUP BY ALL
), series AS MATERIALIZED (
    SELECT o.*, b.paid AS base FROM own o JOIN own b ON b.model = 'copy' AND b.service_level = o.service_level AND b.origin = o.origin
), {_with_ends("series", "model, service_level", {"units": "avg(staffed)", "cost": "avg(paid)", "cost_change": "avg(paid) - avg(base)"}, 53, {"cost_change": "model <> 'copy'"}, ", avg(needed) AS oracle_units")},
       round(oracle_units, 6) AS oracle_units
FROM whole JOIN ends USING (model, service_level)""")
PINBALL_SKILL = two_models(f"""
, {_blocks(_AFTER_WINDOW)}, flat AS (
    SELECT level, origin, k, avg(m.losses[k]) AS score, avg(c.losses[k]) AS base
    FROM mean_scores m JOIN copy_scores c USING (level, origin, node, step), generate_series(1, 11) t(k) GROUP BY ALL
), drawn AS (
    SELECT level, k, r, 1 - avg(score) / avg(base) AS skill FROM starts JOIN flat ON origin - 53 >= lo AND origin - 53 < lo + len GROUP BY ALL
), ends AS (SELECT level, k, quantile_cont(skill, 0.025) AS low, quantile_cont(skill, 0.975) AS high FROM drawn GROUP BY ALL)
SELECT 'mean' AS model, f.level, {list(REPORTING)}[f.k] AS quantile, round(1 - avg(score) / avg(base), 6) AS skill, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high
FROM flat f JOIN ends e ON e.level = f.level AND e.k = f.k GROUP BY f.level, f.k""")
OWN_WINDOWS = two_models("""
, dated AS (SELECT DISTINCT origin, day FROM origins JOIN panel ON day_idx = origin_idx), named("window", cutoff) AS (VALUES ('clean', DATE '1999-01-01'), ('cross_check', DATE '2000-06-01')),
both_models AS (
    SELECT level, origin, avg(m.crps) AS score, avg((m.y BETWEEN m.q[3] AND m.q[9])::INT) AS hit, avg(c.crps) AS base
    FROM mean_scores m JOIN copy_scores c USING (level, origin, node, step) GROUP BY ALL
), member AS (SELECT "window", origin, min(day) OVER (PARTITION BY "window") AS first_day FROM dated, named WHERE day >= cutoff)
SELECT "window", first_day, 'mean' AS model, level, count(*) AS origins, round(avg(score), 6) AS crps, round(1 - avg(score) / avg(base), 6) AS skill,
       round(avg(score - base), 6) AS difference, round(avg(hit), 6) AS coverage FROM both_models JOIN member USING (origin) GROUP BY ALL""")
_INTERVALS = """
SELECT p.origin, p.node, p.step, round(half, 6) AS half, CASE WHEN half IS NOT NULL THEN round(greatest(point - half, 0), 6) END AS low, round(point + half, 6) AS high"""
ACI = adaptive(_INTERVALS + " FROM copied p LEFT JOIN (SELECT * FROM widths WHERE gamma = 0.01::DOUBLE) w USING (origin, node, step)")
AGACI = adaptive(f"""
, losses AS (
    SELECT gamma, node, step, origin, half, coalesce(greatest(0.95 * (score - half), (0.95 - 1) * (score - half)), 0) AS loss, lag FROM seq JOIN widths USING (node, step, origin)
), summed AS (
    SELECT gamma, node, step, origin, half, coalesce(sum(loss) OVER (PARTITION BY gamma, node, step ORDER BY origin RANGE BETWEEN UNBOUNDED PRECEDING AND lag PRECEDING), 0) AS total FROM losses
), weighted AS (
    SELECT *, exp(-0.05 * (total - min(total) OVER (PARTITION BY node, step, origin))) AS w FROM summed
), mixed AS (SELECT node, step, origin, sum(w * half) / sum(w) AS half FROM weighted GROUP BY ALL)
{_INTERVALS} FROM copied p LEFT JOIN mixed USING (origin, node, step)""")
COVERAGE_SERIES = of("""
, daily AS (SELECT level, origin, avg(hit::INT) AS coverage, avg(high - low) AS width FROM split WHERE half IS NOT NULL AND origin >= 53 GROUP BY ALL)
SELECT 'split' AS method, 0.9::DOUBLE AS nominal, level, origin, round(coverage, 6) AS coverage, round(width, 6) AS width,
       CASE WHEN count(*) OVER w = 13 THEN round(avg(coverage) OVER w, 6) END AS rolling
FROM daily WINDOW w AS (PARTITION BY level ORDER BY origin ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)""")
FAN = of("""
, last AS (SELECT max(origin) AS origin FROM origins), shown AS (
    SELECT p.node, p.step, p.y, p.q, CAST(d.day AS VARCHAR) AS day FROM predictive p JOIN last USING (origin) JOIN origins o USING (origin) JOIN days d ON d.day_idx = o.origin_idx + p.step
) SELECT node, list(day ORDER BY step) AS days, list_transform([3, 5, 6, 7, 9], lambda k: list_transform(list(q ORDER BY step), lambda x: round(x[k], 6))) AS bands, list(y ORDER BY step) AS actual
FROM shown GROUP BY node""")
EXTENT = of(f"""
, rolled AS (
    SELECT level, origin, CASE WHEN count(c) OVER w = 13 THEN avg(c) OVER w END AS r
    FROM (SELECT level, origin, CAST(sum(hit::INT) AS DOUBLE) AS c FROM split GROUP BY ALL) WINDOW w AS (PARTITION BY level ORDER BY origin ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
) SELECT level, round(avg(r), 6) AS mean, round(min(r), 6) AS lowest, arg_min(origin, (r, origin)) AS lowest_at, round(min(r), 6) AS low, round(max(r), 6) AS high
FROM rolled WHERE r IS NOT NULL GROUP BY level""")
