"""Report tables, chart tables and the dashboard payload."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import REPORTING, Schedule, check_level
from ..functions import calendar, scores
from ..operators import inference
from ..operators import schedule as plan
from ..operators.conformal import first_valid_origin
from ..operators.decision import DecisionInputs

#: Origins in the rolling window of reports: 91 days.
ROLLING_DAYS = 91
#: Levels of the fan chart.
FAN = (0.05, 0.25, 0.5, 0.75, 0.95)
SCHEMA_VERSION = 2


@dataclass(frozen=True)
class Estimate:
    """A value with its interval, which must hold it; the ends are None where there are too few origins."""

    point: float
    low: float | None = None
    high: float | None = None

    def __post_init__(self) -> None:
        if self.low is not None and self.high is not None and not self.low <= self.point <= self.high:
            raise ValueError(f"{self.point} lies outside [{self.low}, {self.high}]")


def number(x: float) -> str:
    """Digits by size: none from 100, one from 10, two from 1, else three; never a negative zero."""
    digits = 0 if abs(x) >= 100 else 1 if abs(x) >= 10 else 2 if abs(x) >= 1 else 3
    text = f"{x:.{digits}f}"
    return text.lstrip("-") if float(text) == 0 else text


def estimate(e: Estimate) -> str:
    return number(e.point) if e.low is None or e.high is None else f"{number(e.point)} [{number(e.low)}, {number(e.high)}]"


def duration(seconds: float) -> str:
    """Whole minutes under an hour, one at least; hours with one digit from there. Negative and endless times are refused."""
    if not 0 <= seconds < math.inf:
        raise ValueError(f"{seconds} is no length of time")
    minutes = seconds / 60
    return f"{max(round(minutes), 1)} min" if minutes < 60 else f"{minutes / 60:.1f} h"


def markdown(header: list[str], rows: list[list[str]]) -> str:
    if any(len(r) != len(header) for r in rows) or any("|" in c for r in [header, *rows] for c in r):
        raise ValueError("rows must have the header's length and no bars")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def splice(text: str, block: str, begin: str = "<!-- report:begin -->", end: str = "<!-- report:end -->") -> str:
    """The text with ``block`` between its markers."""
    head, found, rest = text.partition(begin)
    _, closed, tail = rest.partition(end)
    if not found or not closed:
        raise ValueError("the markers are missing")
    return f"{head}{begin}\n{block}\n{end}{tail}"


def skill_table(own: DataFrame, base: DataFrame, blocks: DataFrame | None, schedule: Schedule, coverage_at: int = 1) -> DataFrame:
    """``model, level, crps, skill, low, high, median_skill, coverage, worst, width`` of scores against a baseline's, by level.

    Both tables come from ``score_forecasts`` and are compared on the origins they
    share. The skill interval is null where ``blocks`` is None or too few origins remain.
    """
    both = _by_origin(own, base, coverage_at)
    rolled = scores.rolling(both, "hit", ROLLING_DAYS // schedule.step, ["model", "level"])
    columns = {
        "crps": F.avg("score"), "skill": 1 - F.avg("score") / F.avg("base"), "median_skill": 1 - F.avg("mid") / F.avg("base_mid"),
        "coverage": F.avg("hit"), "width": F.avg("width"), "origins": F.count("*"), "worst": F.min("rolling"),
    }
    if blocks is None:
        table = rolled.groupBy("model", "level").agg(*(c.alias(n) for n, c in columns.items()))
        return table.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    return inference.with_skill_interval(_placed(rolled, ["model", "level"]), blocks, ["model", "level"], **columns)


def _by_origin(own: DataFrame, base: DataFrame, coverage_at: int) -> DataFrame:
    """``model, level, origin, score, mid, hit, width, base, base_mid``: means of two scored tables on the origins they share."""
    middle = F.element_at("pinball", REPORTING.index(0.5) + 1)
    hit, width = F.col("hits")[coverage_at].cast("double"), F.col("widths")[coverage_at]
    mine = own.groupBy("model", "level", "origin").agg(F.avg("crps").alias("score"), F.avg(middle).alias("mid"), F.avg(hit).alias("hit"), F.avg(width).alias("width"))
    theirs = base.groupBy("level", "origin").agg(F.avg("crps").alias("base"), F.avg(middle).alias("base_mid"))
    return mine.join(theirs, ["level", "origin"])  # a row for each model, level and origin


#: What a row of the comparison states, each with the ends of its interval.
ROW_STATISTICS = {
    "crps": lambda mean: mean("score"),
    "skill": inference.skill_of("score", "base"),
    "median_skill": inference.skill_of("mid", "base_mid"),
    "coverage": lambda mean: mean("hit"),
    "interval_width": lambda mean: mean("width"),
}


def skill_rows(own: DataFrame, base: DataFrame, blocks: DataFrame, schedule: Schedule, origin_days: DataFrame, baseline: str, coverage_at: int = 1) -> DataFrame:
    """Rows of the comparison: ``model, level, origins, worst, worst_day`` and ``ROW_STATISTICS``, each with ``_low`` and ``_high``.

    All statistics of a row are resampled together. The worst rolling coverage is
    dated by the origin that ends its window, the first of equal ones; both are null
    without a full window. The baseline's own rows have no skills. ``origin_days``
    has ``origin, day``.
    """
    both = _by_origin(own, base, coverage_at)
    rolled = scores.rolling(both, "hit", ROLLING_DAYS // schedule.step, ["model", "level"])
    lowest = F.min(F.when(F.col("rolling").isNotNull(), F.struct(F.round("rolling", 9).alias("value"), "origin")))
    placed = _placed(rolled, ["model", "level"])
    values = ["score", "base", "mid", "base_mid", "hit", "width"]
    found = inference.with_intervals(placed, blocks, ["model", "level"], values, ROW_STATISTICS, origins=F.count("*"), lowest=lowest)
    dated = found.withColumns({"worst": F.col("lowest.value"), "origin": F.col("lowest.origin")}).drop("lowest").join(origin_days, "origin", "left")
    skills = [f"{n}{end}" for n in ("skill", "median_skill") for end in ("", "_low", "_high")]
    return dated.withColumnRenamed("day", "worst_day").drop("origin").withColumns({c: F.when(F.col("model") != baseline, F.col(c)) for c in skills})


def staffing_rows(staffed: DataFrame, reference: str, blocks: DataFrame) -> DataFrame:
    """``model, service_level, origins, oracle_units`` and ``units, cost, cost_change``, each with ``_low`` and ``_high``.

    ``staffed`` comes from ``decision.staffing``. The change is against the reference
    on the same drawn origins; the reference's own rows have none. A method is
    compared on the origins that it shares with the reference.
    """
    theirs = staffed.filter(F.col("model") == reference).select("service_level", "origin", F.col("cost").alias("base"))
    mine = staffed.select("model", "service_level", "origin", "oracle_units", F.col("units").alias("staffed"), F.col("cost").alias("paid"))
    keys = ["model", "service_level"]
    series = _placed(mine.join(theirs, ["service_level", "origin"]), keys)
    statistics = {"units": lambda mean: mean("staffed"), "cost": lambda mean: mean("paid"), "cost_change": lambda mean: mean("paid") - mean("base")}
    oracle = series.withColumnRenamed("oracle_units", "needed")
    found = inference.with_intervals(oracle, blocks, keys, ["staffed", "paid", "base"], statistics, origins=F.count("*"), oracle_units=F.avg("needed"))
    return found.withColumns({c: F.when(F.col("model") != reference, F.col(c)) for c in ("cost_change", "cost_change_low", "cost_change_high")})


def reconciliation_rows(base: DataFrame, variants: dict[str, DataFrame], blocks: DataFrame, coverage_at: int = 1) -> DataFrame:
    """``method, level, origins`` and ``crps, crps_change, coverage``, each with ``_low`` and ``_high``.

    All tables are scores. A change is that of the CRPS against the scores ``base`` of
    the forecasts as they were, on the same drawn origins.
    """
    hit = F.col("hits")[coverage_at].cast("double")
    theirs = base.groupBy("level", "origin").agg(F.avg("crps").alias("base"))
    mine = None
    for name, rows in variants.items():
        each = rows.groupBy("level", "origin").agg(F.avg("crps").alias("score"), F.avg(hit).alias("hit")).withColumn("method", F.lit(name))
        mine = each if mine is None else mine.unionByName(each)
    statistics = {"crps": lambda mean: mean("score"), "crps_change": lambda mean: mean("score") - mean("base"), "coverage": lambda mean: mean("hit")}
    keys = ["method", "level"]
    return inference.with_intervals(_placed(mine.join(theirs, ["level", "origin"]), keys), blocks, keys, ["score", "base", "hit"], statistics, origins=F.count("*"))


def _placed(series: DataFrame, keys: list[str]) -> DataFrame:
    """Origins counted from 0 within their key."""
    return series.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("origin")) - 1)


def pinball_skill(own: DataFrame, base: DataFrame, reporting, blocks: DataFrame) -> DataFrame:
    """``model, level, quantile, skill, low, high`` at every reporting level, with bootstrap intervals where origins suffice."""
    flat = lambda rows, *keys: rows.select(*keys, "origin", F.posexplode("pinball").alias("k", "loss")).groupBy(*keys, "origin", "k").agg(F.avg("loss").alias("loss"))
    theirs = flat(base, "level").withColumnRenamed("loss", "base")
    both = flat(own, "model", "level").join(theirs, ["level", "origin", "k"]).withColumnRenamed("loss", "score")
    keys = ["model", "level", "k"]
    found = inference.with_skill_interval(_placed(both, keys), blocks, keys, skill=1 - F.avg("score") / F.avg("base"))
    quantile = F.element_at(F.array(*(F.lit(q) for q in reporting)), F.col("k") + 1).alias("quantile")
    return found.select("model", "level", quantile, "skill", "low", "high")


def best_model(table: DataFrame) -> str:
    """The model of a skill table with the highest mean skill over the levels; ties go to the first name."""
    means = table.groupBy("model").agg(F.avg("skill").alias("skill"))
    return means.orderBy(F.desc("skill"), "model").first()["model"]


def own_window_table(own: DataFrame, base: DataFrame, reference: DataFrame, origin_days: DataFrame, windows, coverage_at: int = 1) -> DataFrame:
    """``window, first_day, model, level, origins, crps, skill, difference, coverage`` on the windows of pretrained models.

    ``difference`` is the CRPS less that of a reference on the same origins. Windows
    overlap and are never pooled.
    """
    score = lambda rows, name, *keys: rows.groupBy(*keys, "level", "origin").agg(F.avg("crps").alias(name), F.avg(F.col("hits")[coverage_at].cast("double")).alias(f"{name}_hit"))
    both = score(own, "score", "model").join(score(base, "base"), ["level", "origin"]).join(score(reference, "other"), ["level", "origin"])
    return plan.in_windows(both, origin_days, windows).groupBy("window", "first_day", "model", "level").agg(
        F.count("*").alias("origins"), F.avg("score").alias("crps"), (1 - F.avg("score") / F.avg("base")).alias("skill"),
        F.avg(F.col("score") - F.col("other")).alias("difference"), F.avg("score_hit").alias("coverage"),
    )


def reconciliation_table(base: DataFrame, moved: DataFrame, paths: DataFrame, facts: DataFrame) -> DataFrame:
    """``level, method, crps, skill, intensity, coherence, negative`` of a model as it is, with moved medians and with reconciled paths.

    The first three are scores of the same origins, ``facts`` the rows of
    ``reconcile``; the skill is against the model as it is.
    """
    mean = lambda rows, name: rows.groupBy("level").agg(F.lit(name).alias("method"), F.avg("crps").alias("crps"))
    rows = mean(base, "own").unionByName(mean(moved, "medians")).unionByName(mean(paths, "paths"))
    own = base.groupBy("level").agg(F.avg("crps").alias("own"))
    known = facts.agg(F.avg("intensity").alias("intensity"), F.max("coherence").alias("coherence"), F.avg("negative").alias("negative"))
    return rows.join(own, "level").join(F.broadcast(known)).select("level", "method", "crps", (1 - F.col("crps") / F.col("own")).alias("skill"), "intensity", "coherence", "negative")


def coverage_series(found: DataFrame, schedule: Schedule, nominal: float, method: str) -> DataFrame:
    """Chart table ``method, nominal, level, origin, coverage, width, rolling``."""
    own = found.filter(F.col("half").isNotNull() & (F.col("origin") >= first_valid_origin(schedule)))
    daily = own.groupBy("level", "origin").agg(F.avg(F.col("hit").cast("double")).alias("coverage"), F.avg("width").alias("width"))
    rolled = scores.rolling(daily, "coverage", ROLLING_DAYS // schedule.step, ["level"])
    return rolled.select(F.lit(method).alias("method"), F.lit(nominal).alias("nominal"), "level", "origin", "coverage", "width", "rolling")


def compute_cost(seconds: DataFrame, n_origins: int) -> DataFrame:
    """``model, cost``: median seconds an origin, times the origins."""
    each = F.col("seconds") / F.col("origins")
    return seconds.groupBy("model").agg((F.percentile(each, F.lit(0.5)) * n_origins).alias("cost"))


def with_cost(table: DataFrame, seconds: DataFrame, n_origins: int) -> DataFrame:
    """A skill table with ``cost``: seconds that the model takes for so many origins; null for a model without timings.

    ``seconds`` has ``model, origins, seconds``, as the forecast store keeps them by block.
    """
    return table.join(F.broadcast(compute_cost(seconds, n_origins)), "model", "left")  # a row for each model


def _field(name: str):
    """A lambda of one argument: with two, Spark would give it the element's place."""
    return lambda row: row[name]


def range_window(rows: DataFrame, keep: str = "all", shift: tuple[str, str] = ("2019-09-01", "2020-09-01"), year: int = 365) -> DataFrame:
    """Rows (``day``) of a chart's range: all of them, those of a shift (both ends in), or the last year."""
    if keep == "all":
        return rows
    if keep == "shift":
        return rows.filter(F.col("day").between(*(F.lit(x).cast("date") for x in shift)))
    if keep != "year":
        raise ValueError(f"{keep} is no range")
    last = rows.agg(F.max("day").alias("last"))
    return rows.join(F.broadcast(last)).filter(F.col("day") >= F.date_sub("last", year)).drop("last")


def fan(forecasts: DataFrame, days: DataFrame, levels) -> DataFrame:
    """One row a node: days, bands[level][day] and outcomes of the last forecasts, in order."""
    at = [next(k for k, q in enumerate(levels) if abs(q - f) < 1e-9) + 1 for f in FAN]
    rows = forecasts.join(days, "target_idx").select("node", F.struct("day", *(F.element_at("q", k).alias(f"b{i}") for i, k in enumerate(at)), "y").alias("r"))
    sorted_rows = rows.groupBy("node").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # a node's horizon only
    bands = F.array(*(F.transform("rows", _field(f"b{i}")) for i in range(len(at))))
    return sorted_rows.select("node", F.transform("rows", lambda r: r["day"]).alias("days"), bands.alias("bands"), F.transform("rows", lambda r: r["y"]).alias("actual"))


def saving(cost: float, other: float, hours_per_unit_day: float, cost_over: float) -> tuple[float, float]:
    """Unit-days and crew-hours a year that the cheaper plan saves."""
    days = (other - cost) / cost_over * 365
    return days, days * hours_per_unit_day


def clean(value, digits: int = 4):
    """Rounded, with None for what isn't finite, all the way down."""
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: clean(v, digits) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [clean(v, digits) for v in value]
    return value


def validate(value, schema: dict, at: str = "$") -> None:
    """A small JSON Schema check: type, required, properties, items and enum."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    allowed = schema.get("type")
    if allowed and not any(isinstance(value, kinds[k]) and (k in ("boolean",) or not isinstance(value, bool)) for k in ([allowed] if isinstance(allowed, str) else allowed)):
        raise ValueError(f"{at}: not of type {allowed}")
    if "enum" in schema and value not in schema["enum"]:
        raise ValueError(f"{at}: not one of {schema['enum']}")
    for name in schema.get("required", ()):
        if name not in value:
            raise ValueError(f"{at}.{name} is missing")
    for name, own in schema.get("properties", {}).items():
        if isinstance(value, dict) and name in value:
            validate(value[name], own, f"{at}.{name}")
    if "items" in schema and isinstance(value, list):
        for k, item in enumerate(value):
            validate(item, schema["items"], f"{at}[{k}]")


_NUMBER = {"type": ["number", "null"]}
_ROWS = lambda *required, **kinds: {"type": "array", "items": {"type": "object", "required": list(required), "properties": kinds}}
_ESTIMATE = {"type": ["object", "null"]}
PAYLOAD_SCHEMA = {
    "type": "object",
    "required": ["schema_version", "origins", "hierarchy", "models", "staffing", "coverage", "reconciliation", "own_windows", "fan"],
    # sections that a page may do without: comparison, methods, reconciled, regimes
    "properties": {
        "schema_version": {"type": "integer", "enum": [SCHEMA_VERSION]},
        "origins": {"type": "object", "required": ["count", "step", "horizon"]},
        "hierarchy": _ROWS("node", "level"),
        "models": _ROWS("model", "level", "crps", "skill", "low", "high", crps=_NUMBER, skill=_NUMBER, low=_NUMBER, high=_NUMBER),
        "staffing": _ROWS("model", "service_level", "units", "cost"),
        "coverage": _ROWS("method", "level", "origin", "coverage"),
        "reconciliation": _ROWS("level", "method", "crps", "skill", "coherence"),
        "own_windows": _ROWS("window", "first_day", "level", "origins", "crps"),
        "comparison": {
            "type": "object", "required": ["nominal", "baseline", "rows"],
            "properties": {"rows": _ROWS("name", "kind", "fit_seconds", "levels", fit_seconds=_NUMBER, levels=_ROWS("level", "origins", *ROW_STATISTICS, skill=_ESTIMATE, crps=_ESTIMATE, coverage=_ESTIMATE))},
        },
        "methods": {
            "type": "object", "required": ["inputs", "oracle_units", "reference", "service_levels", "methods"],
            "properties": {"methods": _ROWS("name", "units", "cost", "cost_change"), "service_levels": {"type": "array", "items": {"type": "number"}}},
        },
        "reconciled": _ROWS("level", "variants", variants=_ROWS("name", "crps", "crps_change", "coverage", crps_change=_ESTIMATE)),
        "regimes": _ROWS("name", "first", "last", "origins"),
        "fan": {
            "type": "object", "required": ["levels", "nodes", "days", "actual", "bands"],
            "properties": {"levels": {"type": "array", "items": {"type": "number"}}, "nodes": {"type": "array", "items": {"type": "string"}}, "bands": {"type": "array", "items": {"type": "array"}}},
        },
    },
}


def fan_section(table: DataFrame) -> dict:
    """The fan chart node by node, ``bands[node][level][day]``; nodes of other days than the first's are refused."""
    rows = table.orderBy("node").collect()  # a horizon for each node
    days = [str(d) for d in rows[0]["days"]] if rows else []
    if any([str(d) for d in r["days"]] != days or any(len(b) != len(days) for b in r["bands"]) for r in rows):
        raise ValueError("the nodes of a fan chart must share their days")
    return {"levels": list(FAN), "nodes": [r["node"] for r in rows], "days": days, "actual": [list(r["actual"]) for r in rows], "bands": [[list(b) for b in r["bands"]] for r in rows]}


def interval_of(row: dict, name: str, digits: int = 6) -> dict | None:
    """``name`` of a row with its ends as ``{"point", "low", "high"}``; None where there is no value, and an interval must hold its point."""
    if row[name] is None:
        return None
    at = lambda end: None if row[name + end] is None else round(row[name + end], digits)
    return asdict(Estimate(round(row[name], digits), at("_low"), at("_high")))


def _grouped(table: DataFrame, key: str, *order: str) -> dict[str, list[dict]]:
    """Rows of a report table by its key, in order."""
    out: dict[str, list[dict]] = {}
    for row in table.orderBy(key, *order).collect():  # bounded by models, levels and service levels
        out.setdefault(row[key], []).append(row.asDict())
    return out


def comparison_section(rows: DataFrame, baseline: str, nominal: float, kinds: dict[str, str], seconds: DataFrame | None = None, n_origins: int = 0) -> dict:
    """Models with their kind, cost and levels from ``skill_rows``; ``seconds`` are timings, as ``compute_cost`` takes them."""
    cost = {r["model"]: r["cost"] for r in compute_cost(seconds, n_origins).collect()} if seconds is not None else {}
    found = _grouped(rows, "model", "level")
    if baseline not in found:
        raise ValueError(f"baseline {baseline} is not among the models")
    each = lambda r: {"level": check_level(r["level"]), "origins": r["origins"], "worst": r["worst"], "worst_day": r["worst_day"] and str(r["worst_day"]), **{n: interval_of(r, n) for n in ROW_STATISTICS}}
    models = [{"name": m, "kind": kinds.get(m, "baseline"), "fit_seconds": cost.get(m), "levels": [each(r) for r in own]} for m, own in found.items()]
    return {"nominal": nominal, "baseline": baseline, "rows": models}


def methods_section(rows: DataFrame, reference: str, inputs: DecisionInputs) -> dict:
    """Staffing methods at every service level from ``staffing_rows``, and what their costs save a year against the reference."""
    found = _grouped(rows, "model", "service_level")
    if reference not in found:
        raise ValueError(f"reference {reference} is not among the methods")
    levels = [r["service_level"] for r in found[reference]]
    methods = []
    for name, own in found.items():
        if [r["service_level"] for r in own] != levels:
            raise ValueError(f"{name} lacks service levels")
        saved = [None if r["cost_change"] is None else saving(r["cost"], r["cost"] - r["cost_change"], inputs.hours_per_unit_day, inputs.cost_over) for r in own]
        methods.append({"name": name, **{c: [interval_of(r, c) for r in own] for c in ("units", "cost", "cost_change")}, "hours_saved": [s and s[1] for s in saved]})
    stated = {"demand_per_unit": inputs.demand_per_unit, "cost_over": inputs.cost_over, "cost_under": inputs.cost_under, "hours_per_unit_day": inputs.hours_per_unit_day}
    return {"inputs": stated | {"implied_service_level": inputs.critical_ratio}, "oracle_units": found[reference][0]["oracle_units"], "reference": reference, "service_levels": levels, "methods": methods}


def reconciled_section(rows: DataFrame) -> list[dict]:
    """Levels with their variants from ``reconciliation_rows``."""
    variant = lambda r: {"name": r["method"], **{n: interval_of(r, n) for n in ("crps", "crps_change", "coverage")}}
    return [{"level": check_level(level), "variants": [variant(r) for r in own]} for level, own in _grouped(rows, "level", "method").items()]


def regimes_section(origin_days: DataFrame, marks) -> list[dict]:
    """``name, first, last, origins`` of the regimes that hold origins; days before the first mark have no name."""
    known = calendar.regimes(origin_days, marks).groupBy("regime").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("origins"))
    return [{"name": r["regime"], "first": str(r["first"]), "last": str(r["last"]), "origins": r["origins"]} for r in known.orderBy("first").collect()]


def payload(schedule: Schedule, n_origins: int, nodes: DataFrame, models: DataFrame, staffing: DataFrame, coverage: DataFrame, reconciliation: DataFrame, own_windows: DataFrame, fans: DataFrame, **sections) -> dict:
    """The dashboard's payload from report tables, each bounded by models, levels, nodes and origins; checked before it is returned.

    ``sections`` are those of the section builders above.
    """
    rows = lambda df: [{k: str(v) if isinstance(v, date) else v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]
    means = staffing.groupBy("model", "service_level").agg(*(F.avg(c).alias(c) for c in ("units", "oracle_units", "cost")))
    out = {
        "schema_version": SCHEMA_VERSION,
        "origins": {"count": n_origins, "step": schedule.step, "horizon": schedule.horizon},
        "hierarchy": rows(nodes.orderBy("node_ord").select("node", "level")),
        "models": rows(models.orderBy("model", "level")),
        "staffing": rows(means.orderBy("model", "service_level")),
        "coverage": rows(coverage.orderBy("method", "level", "origin")),
        "reconciliation": rows(reconciliation.orderBy("level", "method")),
        "own_windows": rows(own_windows.orderBy("window", "level")),
        "fan": fan_section(fans),
        **sections,
    }
    out = clean(out, 6)
    validate(out, PAYLOAD_SCHEMA)
    return out


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Compact JSON without NaN as one text file under ``path``, wherever Spark can write."""
    text = json.dumps(value, allow_nan=False, separators=(",", ":"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
