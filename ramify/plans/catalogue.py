"""The registered queries over the star schema and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, NOMINAL, REPORTING, SCORING, Schedule
from ..functions import calendar, scores
from ..operators import boosting, checks, conformal, decision, design, hierarchy, inference, naive, neural, reconcile, schedule as plan, statistical
from ..sources import ingest, paged, star
from ..streaming import online
from . import backtest as bt
from . import report, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Origins of the two baselines are compared over this rolling window: a quarter at a weekly step.
QUARTER = 13


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


# ingest and quality


@query(sql.EVENTS_DAILY)
def events_daily(spark, folder):
    events = star.read(spark, folder, "events")
    return ingest.grouped_counts(events, "1990-01-01", "2100-01-01", "ts", "event_type")


@query(sql.YEAR_WINDOWS)
def year_windows(spark, folder):
    return ingest.year_windows(spark, date(1995, 1, 2), date(2001, 11, 5))


@query(sql.of("SELECT day, borough, area, CAST(n AS DOUBLE) AS n FROM demand WHERE day >= DATE '1994-06-01' AND day < DATE '1997-03-15'"))
def paged_counts(spark, folder):
    """Daily demand written as pages of 1,000 rows and read again for a range of days, one task a year."""
    pages = paged.scratch(spark)
    paged.write_pages(star.leaf_counts(spark, folder), pages, 1000)
    return paged.read_pages(spark, pages, 1000).filter("day >= date'1994-06-01' and day < date'1997-03-15'")


@query(sql.TIDY)
def tidy_counts(spark, folder):
    counts = star.raw_counts(spark, folder)
    raw = counts.select(
        F.concat(F.col("day").cast("string"), F.lit("T00:00:00.000")).alias("day"), F.lower("borough").alias("borough"),
        F.concat(F.lit(" "), F.col("area")).alias("area"), F.col("n").cast("bigint").cast("string").alias("n"),
    )
    return ingest.tidy(raw)


@query(sql.of("SELECT day, borough, area, n FROM demand"))
def daily_demand(spark, folder):
    return star.leaf_counts(spark, folder)


@query(sql.raw("SELECT area, borough FROM assigned"))
def nation_argmax(spark, folder):
    return checks.assign_areas(star.raw_counts(spark, folder))


@query(sql.raw("SELECT r.day, a.borough, r.area, sum(r.n) AS n FROM raw r JOIN assigned a USING (area) GROUP BY ALL"))
def leaf_counts(spark, folder):
    counts = star.raw_counts(spark, folder)
    return checks.recount(counts, checks.assign_areas(counts))


@query(sql.DISAGREEMENT)
def assignment_disagreement(spark, folder):
    counts = star.raw_counts(spark, folder)
    out = checks.disagreement(counts, checks.assign_areas(counts))
    return out.withColumn("share", r6("share"))


@query(sql.of("SELECT unnest(generate_series((SELECT min(day) FROM demand), (SELECT max(day) FROM demand), INTERVAL 1 DAY))::DATE AS day EXCEPT SELECT day FROM demand"))
def missing_days(spark, folder):
    return checks.missing_days(star.leaf_counts(spark, folder))


@query(sql.of("SELECT area, count(*) AS missing, min(day) AS first FROM (SELECT DISTINCT area FROM demand) CROSS JOIN days LEFT JOIN demand USING (area, day) WHERE n IS NULL GROUP BY area"))
def missing_area_days(spark, folder):
    found = checks.missing_days(star.leaf_counts(spark, folder), "area")
    return found.groupBy("area").agg(F.count("*").alias("missing"), F.min("day").alias("first"))


@query(sql.COVERAGE)
def area_coverage(spark, folder):
    return checks.coverage(star.leaf_counts(spark, folder)).withColumn("share", r6("share"))


@query(sql.OUTLIERS)
def demand_outliers(spark, folder):
    daily = star.leaf_counts(spark, folder).groupBy("day").agg(F.sum("n").alias("value"))
    return checks.outliers(daily, threshold=2.0).withColumn("z", r6("z"))


@query(sql.of("SELECT area, span, round(per_day, 6) AS per_day, kept FROM leaves"))
def leaf_filter(spark, folder):
    return hierarchy.leaf_quality(star.leaf_counts(spark, folder)).withColumn("per_day", r6("per_day"))


@query(sql.of("SELECT coalesce(sum(n) FILTER (NOT kept), 0.0) AS dropped, sum(n) AS total, round(coalesce(sum(n) FILTER (NOT kept), 0.0) / sum(n), 6) AS share FROM demand JOIN leaves USING (area)"))
def dropped_share(spark, folder):
    return hierarchy.dropped_share(star.leaf_counts(spark, folder)).withColumn("share", r6("share"))


# hierarchy and panel


@query(sql.of("SELECT day, day_idx, borough, area, n FROM grid"))
def dense_grid(spark, folder):
    return hierarchy.dense_grid(star.leaf_counts(spark, folder))


@query(sql.PIVOT)
def pivot_region(spark, folder):
    return hierarchy.pivot_boroughs(star.leaf_counts(spark, folder), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query(sql.of("SELECT 'ALL' AS node, 'ALL/' || borough || '/' || area AS leaf FROM paths UNION ALL SELECT 'ALL/' || borough, 'ALL/' || borough || '/' || area FROM paths UNION ALL SELECT 'ALL/' || borough || '/' || area, 'ALL/' || borough || '/' || area FROM paths"))
def summing_matrix(spark, folder):
    return hierarchy.summing(star.leaf_counts(spark, folder))


@query(sql.NODES)
def hierarchy_nodes(spark, folder):
    return hierarchy.nodes(star.leaf_counts(spark, folder))


@query(sql.of("SELECT node, level, day, day_idx, value FROM panel"))
def panel_rollup(spark, folder):
    return hierarchy.panel(star.leaf_counts(spark, folder))


@query(sql.of("SELECT day, 0.0 AS error FROM panel GROUP BY day"))
def coherence_check(spark, folder):
    s = bt.setup(spark, folder)
    return hierarchy.coherence(s.panel, s.edges, "day").withColumn("error", r6("error"))


# calendar


@query(sql.HOLIDAYS + " SELECT day, holiday, observed FROM holidays")
def holiday_calendar(spark, folder):
    return calendar.holidays(spark, 1995, 2026)


@query(sql.CALENDAR)
def calendar_features(spark, folder):
    return calendar.features(checks.calendar(star.leaf_counts(spark, folder)))


# schedule


@query(sql.of("SELECT origin, origin_idx, train_from, refit, refit_origin FROM origins"))
def origin_schedule(spark, folder):
    return bt.setup(spark, folder).origins


@query(sql.of("SELECT origin, origin_idx FROM origins WHERE 1200 BETWEEN origin_idx + 1 AND origin_idx + 14"))
def origins_covering(spark, folder):
    return plan.covering(bt.setup(spark, folder).origins, 1200).select("origin", "origin_idx")


@query(sql.of("SELECT origin, origin_idx, day FROM origins JOIN (SELECT DISTINCT day, day_idx FROM panel) ON origin_idx = day_idx WHERE day >= DATE '2000-01-01'"))
def clean_window(spark, folder):
    s = bt.setup(spark, folder)
    return plan.clean_origins(s.origins, s.panel.select("day", "day_idx").distinct(), "2000-01-01")


@query(sql.of("SELECT origin, node, level, step, y FROM actuals"))
def actuals_cube(spark, folder):
    return bt.setup(spark, folder).actuals()


# forecasts


@query(sql.of("SELECT origin, node, level, step, point FROM points"))
def naive_point(spark, folder):
    s = bt.setup(spark, folder)
    return naive.points(s.panel, s.origins, s.schedule)


@query(sql.of("SELECT o.origin, p.node, t.step, p.value AS point FROM origins o, generate_series(1, 14) t(step), panel p WHERE p.day_idx = o.origin_idx + t.step - 7 * ((t.step + 6) // 7)"))
def naive_point_documented(spark, folder):
    s = bt.setup(spark, folder)
    return naive.points(s.panel, s.origins, s.schedule, week2="documented").drop("level")


@query(sql.reported("SELECT origin, node, lag, list_transform(residuals, lambda v: round(v, 6)) AS residuals FROM residuals"))
def naive_residual_quantiles(spark, folder):
    s = bt.setup(spark, folder)
    found = naive.residual_quantiles(s.panel, s.origins, s.schedule, REPORTING)
    return found.withColumn("residuals", F.transform("residuals", r6))


@query(sql.reported("SELECT 'naive' AS model, origin, node, step, list_transform(q, lambda v: round(v, 6)) AS q FROM naive"))
def naive_quantiles(spark, folder):
    s = bt.setup(spark, folder)
    found = naive.seasonal_naive(s.panel, s.origins, s.schedule, REPORTING)
    return found.withColumn("q", F.transform("q", r6))


@query(sql.of("SELECT origin, node, round(greatest(avg(value), 1), 6) AS scale FROM origins JOIN panel ON day_idx BETWEEN train_from AND origin_idx GROUP BY ALL"))
def gbm_scale(spark, folder):
    s = bt.setup(spark, folder)
    return design.scales(s.panel, s.origins).withColumn("scale", r6("scale"))


@query(sql.DESIGN)
def gbm_design(spark, folder):
    s = bt.setup(spark, folder)
    rows = design.design(s.panel, s.nodes, s.schedule.horizon)
    return rows.withColumns({f"mean_{k}": r6(f"mean_{k}") for k in design.MEANS})


# scores


@query(sql.full("SELECT origin, node, step, list_transform(losses, lambda v: round(v, 6)) AS pinball FROM scored"))
def pinball_grid(spark, folder):
    s = bt.setup(spark, folder)
    return bt.naive_scores(s, SCORING, SCORING).select("origin", "node", "step", F.transform("pinball", r6).alias("pinball"))


@query(sql.full("SELECT level, round(avg(crps), 6) AS crps FROM scored GROUP BY level"))
def crps_by_level(spark, folder):
    s = bt.setup(spark, folder)
    return bt.naive_scores(s, SCORING).groupBy("level").agg(r6(F.avg("crps")).alias("crps"))


@query(sql.full("SELECT level, round(avg(crps), 6) AS crps FROM scored GROUP BY level"))
def naive_backtest_crps(spark, folder):
    """The flagship: seasonal naive over all origins, CRPS on the full grid, mean by level."""
    s = bt.setup(spark, folder)
    return bt.naive_scores(s, SCORING).groupBy("level").agg(r6(F.avg("crps")).alias("crps"))


@query(sql.full("SELECT level, round(avg(abs_error), 6) AS mae FROM scored GROUP BY level"))
def mae_by_level(spark, folder):
    return bt.naive_scores(bt.setup(spark, folder), SCORING).groupBy("level").agg(r6(F.avg("abs_error")).alias("mae"))


@query(sql.reported("SELECT level, round(avg((y BETWEEN q[4] AND q[8])::INT), 6) AS hit80, round(avg((y BETWEEN q[3] AND q[9])::INT), 6) AS hit90, round(avg(q[9] - q[3]), 6) AS width90, round(avg(CASE WHEN y > 0 THEN (q[9] - q[3]) / y END), 6) AS relative90 FROM scored GROUP BY level"))
def coverage_width(spark, folder):
    s = bt.setup(spark, folder)
    rows = naive.seasonal_naive(s.panel, s.origins, s.schedule, REPORTING).join(s.actuals(), ["origin", "node", "step"])
    q, y = F.col("q"), F.col("y")
    (l80, h80), (l90, h90) = scores.bounds(q, REPORTING, NOMINAL[0]), scores.bounds(q, REPORTING, NOMINAL[1])
    return rows.groupBy("level").agg(
        r6(F.avg(scores.covered(y, l80, h80).cast("int"))).alias("hit80"), r6(F.avg(scores.covered(y, l90, h90).cast("int"))).alias("hit90"),
        r6(F.avg(h90 - l90)).alias("width90"), r6(F.avg(scores.relative_width(l90, h90, y))).alias("relative90"),
    )


#: Moves each quantile by an amount that depends on its place, origin and step, so that some forecasts cross.
_UNEVEN = "list_transform(q, lambda v, i: v + (((i - 1) * 7 + origin * 3 + step) % 11) * 0.05 * (1 + step % 3))"


def _uneven(s: bt.Setup) -> DataFrame:
    rows = naive.seasonal_naive(s.panel, s.origins, s.schedule, REPORTING).join(s.actuals(), ["origin", "node", "step"])
    shift = lambda v, i: v + F.pmod(i * 7 + F.col("origin") * 3 + F.col("step"), F.lit(11)) * 0.05 * (1 + F.col("step") % 3)
    return rows.withColumn("q", F.transform("q", shift))


@query(sql.reported(f"SELECT level, round(avg(share), 6) AS crossing FROM (SELECT level, origin, avg((len(list_filter(generate_series(1, len(q) - 1), lambda i: q[i + 1] < q[i])) > 0)::INT) AS share FROM (SELECT level, origin, {_UNEVEN} AS q FROM scored) GROUP BY ALL) GROUP BY level"))
def crossing_rate(spark, folder):
    """Share of forecasts whose quantiles cross, for quantiles that were moved unevenly."""
    own = _uneven(bt.setup(spark, folder)).groupBy("level", "origin").agg(F.avg(scores.crosses(F.col("q")).cast("int")).alias("share"))
    return own.groupBy("level").agg(r6(F.avg("share")).alias("crossing"))


@query(sql.reported(f"SELECT origin, node, step, list_transform(list_sort({_UNEVEN}), lambda v: round(v, 6)) AS q FROM scored"))
def repaired_quantiles(spark, folder):
    return _uneven(bt.setup(spark, folder)).select("origin", "node", "step", F.transform(scores.repaired(F.col("q")), r6).alias("q"))


def _copied_errors(s: bt.Setup, rows: DataFrame, model: str) -> DataFrame:
    error = F.abs(F.col("y") - F.col("point"))
    return scores.by_origin(rows.withColumn("model", F.lit(model)), error, "score")


@query(sql.of("SELECT level, round(1 - avg(m.score) / avg(c.score), 6) AS skill FROM copy_errors c JOIN mean_errors m USING (level, origin) GROUP BY level"))
def skill_vs_baseline(spark, folder):
    s = bt.setup(spark, folder)
    base = _copied_errors(s, bt.copied(s), "copy").select("level", "origin", F.col("score").alias("base"))
    own = _copied_errors(s, bt.weekday_mean(s), "mean").join(base, ["level", "origin"])
    means = own.groupBy("level").agg(F.avg("score").alias("s"), F.avg("base").alias("b"))
    return means.select("level", r6(scores.skill(F.col("s"), F.col("b"), strict=True)).alias("skill"))


@query(sql.of("SELECT level, origin, round(c.score - m.score, 6) AS saved FROM copy_errors c JOIN mean_errors m USING (level, origin)"))
def paired_difference(spark, folder):
    """The baseline's error less our own, so positive is better."""
    s = bt.setup(spark, folder)
    base = _copied_errors(s, bt.copied(s), "copy").select("level", "origin", F.col("score").alias("base"))
    return _copied_errors(s, bt.weekday_mean(s), "mean").join(base, ["level", "origin"]).select("level", "origin", r6(F.col("base") - F.col("score")).alias("saved"))


# conformal


def _split(spark, folder) -> tuple[bt.Setup, DataFrame]:
    s = bt.setup(spark, folder)
    return s, conformal.split(bt.copied(s), s.schedule)


@query(sql.of("SELECT origin, node, step, round(half, 6) AS half, round(low, 6) AS low, round(high, 6) AS high FROM split"))
def split_conformal(spark, folder):
    found = _split(spark, folder)[1]
    return found.select("origin", "node", "step", r6("half").alias("half"), r6("low").alias("low"), r6("high").alias("high"))


@query(sql.of("SELECT level, round(avg(hit::INT), 6) AS coverage, round(avg(high - low), 6) AS width FROM split WHERE half IS NOT NULL GROUP BY level"))
def conformal_coverage(spark, folder):
    found = conformal.summary(_split(spark, folder)[1])
    return found.select("level", r6("coverage").alias("coverage"), r6("width").alias("width"))


@query(sql.of(f"SELECT level, origin, CASE WHEN count(c) OVER w = {QUARTER} THEN round(avg(c) OVER w, 6) END AS rolling FROM (SELECT level, origin, avg(hit::INT) AS c FROM split GROUP BY ALL) WINDOW w AS (PARTITION BY level ORDER BY origin ROWS BETWEEN {QUARTER - 1} PRECEDING AND CURRENT ROW)"))
def rolling_coverage(spark, folder):
    own = _split(spark, folder)[1].groupBy("level", "origin").agg(F.avg(F.col("hit").cast("int")).alias("c"))
    return scores.rolling(own, "c", QUARTER, ["level"]).select("level", "origin", r6("rolling").alias("rolling"))


@query(sql.of(f"SELECT level, arg_min(origin, (r, origin)) AS origin, round(min(r), 6) AS worst FROM (SELECT level, origin, CASE WHEN count(c) OVER w = {QUARTER} THEN avg(c) OVER w END AS r FROM (SELECT level, origin, CAST(sum(hit::INT) AS DOUBLE) AS c FROM split GROUP BY ALL) WINDOW w AS (PARTITION BY level ORDER BY origin ROWS BETWEEN {QUARTER - 1} PRECEDING AND CURRENT ROW)) WHERE r IS NOT NULL GROUP BY level"))
def worst_window(spark, folder):
    """Fewest hits in a rolling quarter; counted, so that ties are exact."""
    own = _split(spark, folder)[1].groupBy("level", "origin").agg(F.sum(F.col("hit").cast("double")).alias("c"))
    return scores.worst_window(own, "c", QUARTER, ["level"]).withColumn("worst", r6("worst"))


@query(sql.EXTENT)
def series_extent(spark, folder):
    own = _split(spark, folder)[1].groupBy("level", "origin").agg(F.sum(F.col("hit").cast("double")).alias("c"))
    found = scores.extent(scores.rolling(own, "c", QUARTER, ["level"]), "rolling", ["level"])
    return found.withColumns({c: r6(c) for c in ("mean", "lowest", "low", "high")})


@query(sql.of("SELECT level, origin, step, avg(hit::INT) >= 0.5 AS hit FROM split WHERE half IS NOT NULL GROUP BY ALL"))
def hits_majority(spark, folder):
    found = _split(spark, folder)[1].filter("half is not null")
    return found.groupBy("level", "origin", "step").agg((F.avg(F.col("hit").cast("int")) >= 0.5).alias("hit"))


@query(sql.of("SELECT origin, node, step, list_transform(q, lambda v: round(v, 6)) AS q FROM predictive"))
def predictive_quantiles(spark, folder):
    s = bt.setup(spark, folder)
    found = conformal.predictive(bt.copied(s), s.schedule, REPORTING)
    return found.select("origin", "node", "step", F.transform("q", r6).alias("q"))


def _half_widths(found: DataFrame) -> DataFrame:
    return found.select("origin", "node", "step", *(r6(c).alias(c) for c in ("half", "low", "high")))


@query(sql.ACI)
def aci(spark, folder):
    s = bt.setup(spark, folder)
    return _half_widths(conformal.adaptive(bt.copied(s), s.schedule))


@query(sql.AGACI)
def agaci(spark, folder):
    s = bt.setup(spark, folder)
    return _half_widths(conformal.adaptive(bt.copied(s), s.schedule, aggregated=True))


@query(sql.routed("SELECT 'copy' AS model, origin, node, step, list_transform(q, lambda v: round(v, 6)) AS q FROM predictive UNION ALL SELECT 'naive', origin, node, step, list_transform(q, lambda v: round(v, 6)) FROM naive"))
def routed_distributions(spark, folder):
    """A model that stores a median only gets its conformal distribution, one with quantiles keeps them."""
    s = bt.setup(spark, folder)
    own = naive.seasonal_naive(s.panel, s.origins, s.schedule, REPORTING).select("model", "origin", "node", "step", "q")
    median = naive.points(s.panel, s.origins, s.schedule).select(F.lit("copy").alias("model"), "origin", "node", "step", F.array("point").alias("q"))
    found = conformal.distribution(own.unionByName(median).join(s.actuals(), ["origin", "node", "step"]), s.schedule, REPORTING, {"copy": (0.5,)})
    return found.select("model", "origin", "node", "step", F.transform("q", r6).alias("q"))


# decision


@query(sql.of("SELECT origin, node, step, round(q[7] + (0.8 - 0.75) / (0.9 - 0.75) * (q[8] - q[7]), 6) AS demand80, round(q[8], 6) AS demand90 FROM predictive WHERE level = 'area'"))
def service_demand(spark, folder):
    s = bt.setup(spark, folder)
    found = conformal.predictive(bt.copied(s), s.schedule, REPORTING).filter("level = 'area'")
    at = lambda q: r6(decision.demand_at(F.col("q"), REPORTING, q))
    return found.select("origin", "node", "step", at(0.8).alias("demand80"), at(0.9).alias("demand90"))


@query(sql.STAFFING)
def staffing_cost(spark, folder):
    s = bt.setup(spark, folder)
    found = conformal.predictive(bt.copied(s), s.schedule, REPORTING).withColumn("model", F.lit("copy"))
    out = decision.staffing(found, REPORTING)
    return out.select("model", "service_level", "origin", *(r6(c).alias(c) for c in ("units", "oracle_units", "cost")))


@query(sql.reported(", asked AS (SELECT origin, node, lag, quantile_cont(d, [0.8, 0.9, 0.95]) AS r FROM origins JOIN differences ON day_idx <= origin_idx AND old_idx >= train_from GROUP BY ALL) SELECT p.origin, p.node, p.step, service_level, round(greatest(p.point + r[place], 0), 6) AS demand FROM points p JOIN asked a ON a.origin = p.origin AND a.node = p.node AND a.lag = 7 * ((p.step + 6) // 7), (VALUES (1, 0.8::DOUBLE), (2, 0.9::DOUBLE), (3, 0.95::DOUBLE)) s(place, service_level) WHERE p.level = 'area'"))
def naive_demand(spark, folder):
    s = bt.setup(spark, folder)
    return decision.naive_demand(s.panel, s.origins, s.schedule, (0.8, 0.9, 0.95)).withColumn("demand", r6("demand"))


# inference


@query(sql.BOOTSTRAP)
def block_bootstrap_hash(spark, folder):
    s = bt.setup(spark, folder)
    series = _copied_errors(s, bt.copied(s), "copy").select("level", F.col("origin").alias("pos"), "score")
    blocks = inference.arithmetic_blocks(spark, s.schedule.count(s.n_days))
    found = inference.interval(inference.resampled_means(series, blocks, ["score"], ["level"]), "score", ["level"])
    return found.select("level", r6("low").alias("low"), r6("high").alias("high"))


@query()
def bootstrap_skill(spark, folder):
    s = bt.setup(spark, folder)
    base = _copied_errors(s, bt.copied(s), "copy").select("level", "origin", F.col("score").alias("base"))
    series = _copied_errors(s, bt.weekday_mean(s), "mean").join(base, ["level", "origin"]).withColumn("pos", F.col("origin"))
    blocks = inference.block_table(spark, s.schedule.count(s.n_days))
    return inference.skill_interval(series, blocks, ["level"])


# reconciliation


@query(sql.reported("SELECT origin, round(max(abs(q[6] - summed)), 6) AS error FROM naive p JOIN (SELECT n.origin, n.step, parent.node, sum(n.q[6]) AS summed FROM naive n JOIN (SELECT DISTINCT node FROM panel) parent ON n.node = parent.node OR starts_with(n.node, parent.node || '/') WHERE n.level = 'area' GROUP BY ALL) USING (origin, step, node) GROUP BY origin"))
def base_breach(spark, folder):
    """How far the naive medians of a node are from the sum of its leaves'."""
    s = bt.setup(spark, folder)
    medians = naive.seasonal_naive(s.panel, s.origins, s.schedule, REPORTING).select("origin", "node", "step", F.element_at("q", 6).alias("value"))
    return hierarchy.coherence(medians, s.edges, "origin", "step").groupBy("origin").agg(r6(F.max("error")).alias("error"))


@query(sql.reported("SELECT n.origin, n.node, n.step, list_transform(q, lambda v: round(greatest(v + (m.point - q[6]), 0), 6)) AS q FROM naive n JOIN mean_points m ON m.origin = n.origin AND m.node = n.node AND m.step = n.step"))
def shift_quantiles(spark, folder):
    """The naive quantiles moved so that the weekday mean is their median."""
    s = bt.setup(spark, folder)
    found = naive.seasonal_naive(s.panel, s.origins, s.schedule, REPORTING).join(bt.weekday_mean(s).select("origin", "node", "step", "point"), ["origin", "node", "step"])
    moved = reconcile.shift_quantiles(F.col("q"), F.element_at("q", 6), F.col("point"))
    return found.select("origin", "node", "step", F.transform(moved, r6).alias("q"))


def _reconciled(spark, folder, levels=()) -> DataFrame:
    s = bt.setup(spark, folder)
    return reconcile.reconcile(bt.weekday_mean(s), s.edges, s.schedule, levels=levels)


@query()
def mint_medians(spark, folder):
    return _reconciled(spark, folder).select("origin", "node", "step", "median", "intensity")


@query()
def mint_paths(spark, folder):
    return _reconciled(spark, folder, REPORTING)


@query(sql.of("SELECT CAST(origin AS INTEGER) AS origin, CAST(step AS INTEGER) AS step, true AS coherent FROM origins, generate_series(1, 14) t(step) WHERE origin >= 53"))
def mint_coherence(spark, folder):
    """Reconciled medians add up, at every origin with a full window and every step."""
    s = bt.setup(spark, folder)
    found = reconcile.reconcile(bt.weekday_mean(s), s.edges, s.schedule).select("origin", "node", "step", F.col("median").alias("value"))
    return hierarchy.coherent(found, s.edges, "origin", "step")


def _naive_with_actuals(s: bt.Setup, levels) -> DataFrame:
    return naive.seasonal_naive(s.panel, s.origins, s.schedule, levels).join(s.actuals().drop("level"), ["origin", "node", "step"])


@query()
def mint_quantiles(spark, folder):
    """The naive quantiles moved with their reconciled medians."""
    s = bt.setup(spark, folder)
    return reconcile.reconciled_quantiles(_naive_with_actuals(s, REPORTING), s.edges, s.schedule, REPORTING)


#: The default schedule with a refit each half-year, for models that are costly to fit.
SELDOM = Schedule(refit_every=2 * QUARTER)
#: A quarter of the default rounds at four times their rate.
FEWER_ROUNDS = boosting.Boosting(rounds=100, rate=0.2)


@query()
def gbt(spark, folder):
    """Boosted forecasts of all origins by models refitted each half-year, as points with their errors by level."""
    s = bt.setup(spark, folder, SELDOM)
    found = boosting.boosted(s.panel, s.nodes, s.origins, s.schedule, FEWER_ROUNDS)
    return found.join(s.actuals().drop("level"), ["origin", "node", "step"]).groupBy("model", "level").agg(F.avg(F.abs(F.col("y") - F.col("point"))).alias("mae"))


#: Forecast origins four weeks apart, for the statistical models.
MONTHLY = Schedule(step=28)


def _statistical(spark, folder, name: str) -> DataFrame:
    s = bt.setup(spark, folder, MONTHLY)
    found = statistical.forecast(s.panel, s.origins, s.schedule, SCORING, {name: statistical.MODELS[name]})
    scored = scores.score_forecasts(found, s.actuals(), SCORING, REPORTING, NOMINAL)
    return _by_level(scored)


@query()
def network(spark, folder):
    """The multi-rate network on all origins, refitted each half-year, scored by level."""
    s = bt.setup(spark, folder, SELDOM)
    found = neural.forecast(s.panel, s.origins, s.schedule, SCORING)
    return _by_level(scores.score_forecasts(found, s.actuals(), SCORING, REPORTING, NOMINAL))


def _by_level(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "level").agg(F.avg("crps").alias("crps"), F.avg(F.col("hits")[1].cast("int")).alias("coverage90"))


@query()
def ets(spark, folder):
    return _statistical(spark, folder, "ets")


@query()
def theta(spark, folder):
    return _statistical(spark, folder, "theta")


@query()
def mstl(spark, folder):
    return _statistical(spark, folder, "mstl")


@query()
def arima(spark, folder):
    return _statistical(spark, folder, "arima")


# report


def _two_models(s: bt.Setup) -> tuple[DataFrame, DataFrame]:
    """Scores of the weekday mean and of the copied week, both through the conformal distribution."""
    out = []
    for model, rows in (("mean", bt.weekday_mean(s)), ("copy", bt.copied(s))):
        found = conformal.predictive(rows, s.schedule, REPORTING).select(F.lit(model).alias("model"), "origin", "node", "step", "q")
        out.append(scores.score_forecasts(found, s.actuals(), REPORTING, REPORTING, NOMINAL))
    return out[0], out[1]


def _blocks(spark, s: bt.Setup) -> DataFrame:
    """Resamples of the origins with a full window, by a rule that SQL can repeat."""
    return inference.arithmetic_blocks(spark, s.schedule.count(s.n_days) - conformal.first_valid_origin(s.schedule))


def _seeded(spark, s: bt.Setup) -> DataFrame:
    """The same by the seeded generator, which SQL can't repeat."""
    return inference.block_table(spark, s.schedule.count(s.n_days) - conformal.first_valid_origin(s.schedule))


@query(sql.SKILL_TABLE)
def skill_table(spark, folder):
    s = bt.setup(spark, folder)
    own, base = _two_models(s)
    found = report.skill_table(own, base, _blocks(spark, s), s.schedule)
    return found.withColumns({c: r6(c) for c in ("crps", "skill", "median_skill", "coverage", "width", "worst", "low", "high")})


def _dated(s: bt.Setup) -> DataFrame:
    return plan.dated(s.origins, s.panel.select("day", "day_idx"))


def _comparison(s: bt.Setup, own: DataFrame, base: DataFrame, blocks: DataFrame) -> DataFrame:
    return report.skill_rows(own.unionByName(base), base, blocks, s.schedule, _dated(s).select("origin", "day"), "copy")


@query(sql.SKILL_ROWS)
def skill_rows(spark, folder):
    """Both models' rows of the comparison, every statistic with its interval."""
    s = bt.setup(spark, folder)
    found = _comparison(s, *_two_models(s), _blocks(spark, s))
    shown = [f"{n}{end}" for n in report.ROW_STATISTICS for end in ("", "_low", "_high")]
    return found.withColumns({c: r6(c) for c in (*shown, "worst")})


def _methods(s: bt.Setup, blocks: DataFrame) -> DataFrame:
    """Staffing by both models at every level that a planner may choose."""
    inputs = decision.DecisionInputs()
    rows = [conformal.predictive(found, s.schedule, REPORTING).select(F.lit(m).alias("model"), "level", "origin", "node", "step", "y", "q") for m, found in (("mean", bt.weekday_mean(s)), ("copy", bt.copied(s)))]
    staffed = decision.staffing(rows[0].unionByName(rows[1]), REPORTING, inputs, inputs.slider_levels)
    return report.staffing_rows(staffed, "copy", blocks)


@query(sql.STAFFING_ROWS)
def staffing_rows(spark, folder):
    s = bt.setup(spark, folder)
    found = _methods(s, _blocks(spark, s))
    shown = [f"{n}{end}" for n in ("units", "cost", "cost_change") for end in ("", "_low", "_high")]
    return found.withColumns({c: r6(c) for c in (*shown, "oracle_units")})


@query(sql.PINBALL_SKILL)
def pinball_skill(spark, folder):
    s = bt.setup(spark, folder)
    own, base = _two_models(s)
    return report.pinball_skill(own, base, REPORTING, _blocks(spark, s)).withColumns({c: r6(c) for c in ("skill", "low", "high")})


#: Windows of the test tables, which end before the fixed ones begin.
TEST_WINDOWS = (("clean", "1999-01-01"), ("cross_check", "2000-06-01"))


def _own_windows(s: bt.Setup, own: DataFrame, base: DataFrame) -> DataFrame:
    return report.own_window_table(own, base, base, _dated(s), TEST_WINDOWS)


@query(sql.OWN_WINDOWS)
def own_window_rows(spark, folder):
    s = bt.setup(spark, folder)
    found = _own_windows(s, *_two_models(s))
    return found.withColumns({c: r6(c) for c in ("crps", "skill", "difference", "coverage")})


@query(sql.COVERAGE_SERIES)
def coverage_series(spark, folder):
    s, found = _split(spark, folder)
    return report.coverage_series(found, s.schedule, 0.9, "split").withColumns({c: r6(c) for c in ("coverage", "width", "rolling")})


def _fan(s: bt.Setup) -> DataFrame:
    last = s.schedule.count(s.n_days) - 1
    found = conformal.predictive(bt.copied(s), s.schedule, REPORTING).filter(F.col("origin") == last)
    rows = found.join(plan.targets(s.origins, s.schedule).filter(F.col("origin") == last).select("step", "target_idx"), "step")
    return report.fan(rows, s.panel.select("day", F.col("day_idx").alias("target_idx")).distinct(), REPORTING)


@query(sql.FAN)
def fan_chart(spark, folder):
    found = _fan(bt.setup(spark, folder))
    days = F.transform("days", lambda d: d.cast("string")).alias("days")
    return found.select("node", days, F.transform("bands", lambda b: F.transform(b, r6)).alias("bands"), "actual")


@query(sql.of("SELECT origin, node, step, round(q[7] + (0.8 - 0.75) / (0.95 - 0.75) * (q[9] - q[7]), 6) AS demand80, round(q[3], 6) AS demand01 FROM predictive WHERE level = 'area'"))
def service_from_bands(spark, folder):
    """Service quantiles from the five bands of the fan chart alone."""
    s = bt.setup(spark, folder)
    found = conformal.predictive(bt.copied(s), s.schedule, REPORTING).filter("level = 'area'")
    bands = F.array(*(F.element_at("q", REPORTING.index(x) + 1) for x in report.FAN))
    at = lambda wanted: r6(decision.service_quantile(bands, report.FAN, wanted))
    return found.select("origin", "node", "step", at(0.8).alias("demand80"), at(0.01).alias("demand01"))


@query(sql.of("SELECT d.day, 'year' AS range FROM days d, bounds WHERE d.day >= hi - 365 UNION ALL SELECT day, 'shift' FROM days WHERE day BETWEEN DATE '1997-09-01' AND DATE '1998-09-01'"))
def chart_ranges(spark, folder):
    days = checks.calendar(star.leaf_counts(spark, folder))
    cut = lambda keep: report.range_window(days, keep, ("1997-09-01", "1998-09-01")).select("day", F.lit(keep).alias("range"))
    return cut("year").unionByName(cut("shift"))


#: Regimes of the test tables, which end before the fixed ones begin.
TEST_REGIMES = (("first", date(1997, 10, 29)), ("second", date(2000, 3, 1)))


@query(sql.of("SELECT day, CASE WHEN day >= DATE '2000-03-01' THEN 'second' WHEN day >= DATE '1997-10-29' THEN 'first' END AS regime FROM days"))
def regime_days(spark, folder):
    days = checks.calendar(star.leaf_counts(spark, folder))
    return calendar.regimes(days, TEST_REGIMES)


def _reconciled_scores(s: bt.Setup) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scores of the naive forecast as it is, with moved medians and with reconciled paths, on the reporting levels; then the rows of ``reconcile``."""
    rows = _naive_with_actuals(s, REPORTING)
    points = rows.withColumn("point", F.element_at("q", 6))
    facts = reconcile.reconcile(points, s.edges, s.schedule, levels=REPORTING)
    moved = reconcile.reconciled_quantiles(rows, s.edges, s.schedule, REPORTING)
    own = rows.filter(F.col("origin") >= conformal.first_valid_origin(s.schedule)).select("model", "origin", "node", "step", "q")
    paths = facts.select(F.lit("naive").alias("model"), "origin", "node", "step", "q")
    score = lambda found: scores.score_forecasts(found, s.actuals(), REPORTING, REPORTING, NOMINAL)
    return score(own), score(moved), score(paths), facts


@query()
def reconciliation_section(spark, folder):
    return report.reconciliation_table(*_reconciled_scores(bt.setup(spark, folder)))


def _changes(own: DataFrame, moved: DataFrame, paths: DataFrame, blocks: DataFrame) -> DataFrame:
    return report.reconciliation_rows(own, {"medians": moved, "paths": paths}, blocks)


@query()
def reconciliation_changes(spark, folder):
    """What reconciling changes in the CRPS, with the ends over seeded resamples."""
    s = bt.setup(spark, folder)
    return _changes(*_reconciled_scores(s)[:3], _seeded(spark, s))


@query()
def dashboard_payload(spark, folder):
    """One row: the checked payload as JSON."""
    s = bt.setup(spark, folder)
    n = s.schedule.count(s.n_days)
    inputs = decision.DecisionInputs()
    blocks = _seeded(spark, s)
    own, base = _two_models(s)
    plain, moved, paths, facts = _reconciled_scores(s)
    held = [bt.cached(t) for t in (facts, own, base, plain, moved, paths)]  # read by several sections
    timed = bt.timings(s, {"copy": lambda o: naive.points(s.panel, o, s.schedule), "mean": lambda o: bt.weekday_mean(replace(s, origins=o))})
    found = conformal.predictive(bt.copied(s), s.schedule, REPORTING).withColumn("model", F.lit("copy"))
    split = conformal.split(bt.copied(s), s.schedule)
    try:
        value = report.payload(
            s.schedule, n, s.nodes, report.skill_table(own, base, blocks, s.schedule), decision.staffing(found, REPORTING),
            report.coverage_series(split, s.schedule, 0.9, "split"), report.reconciliation_table(plain, moved, paths, facts), _own_windows(s, own, base), _fan(s),
            comparison=report.comparison_section(_comparison(s, own, base, blocks), "copy", 0.9, {}, timed, n),
            methods=report.methods_section(_methods(s, blocks), "copy", inputs), reconciled=report.reconciled_section(_changes(plain, moved, paths, blocks)),
            regimes=report.regimes_section(_dated(s), TEST_REGIMES),
        )
    finally:
        for table in held:
            table.unpersist()
    return spark.createDataFrame([(json.dumps(value, allow_nan=False, separators=(",", ":")),)], "payload string")


# streaming


@query(sql.EVENTS_DAILY)
def stream_daily_counts(spark, folder):
    schema = star.read(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return online.collected(online.daily_counts(events, "event_type"), f"counts_{uuid.uuid4().hex}", "complete")
