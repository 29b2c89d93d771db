"""Newsvendor staffing: from forecast demand to units and realised cost."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SLIDER, Schedule, check_levels
from . import naive


@dataclass(frozen=True)
class DecisionInputs:
    """Illustrative costs; read your own with ``load_inputs``."""

    demand_per_unit: float = 10.0
    cost_over: float = 1.0
    cost_under: float = 4.0
    hours_per_unit_day: float = 24.0
    service_levels: tuple[float, ...] = (0.80, 0.90, 0.95)

    def __post_init__(self) -> None:
        if min(self.demand_per_unit, self.cost_over, self.cost_under, self.hours_per_unit_day) <= 0:
            raise ValueError("demand_per_unit, costs and hours must be positive")
        check_levels(self.service_levels)

    @property
    def critical_ratio(self) -> float:
        return self.cost_under / (self.cost_under + self.cost_over)

    @property
    def levels(self) -> list[float]:
        """Service levels with the one that the costs imply."""
        return sorted({round(self.critical_ratio, 9), *self.service_levels})

    @property
    def slider_levels(self) -> list[float]:
        """Those and the levels that a planner may slide between."""
        return sorted({*self.levels, *SLIDER})


def load_inputs(path: str) -> DecisionInputs:
    with open(path, "rb") as file:
        given = tomllib.load(file)
    if unknown := set(given) - {f.name for f in fields(DecisionInputs)}:
        raise ValueError(f"unknown inputs: {sorted(unknown)}")
    return DecisionInputs(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def demand_at(q: Column, levels, wanted: float) -> Column:
    """The quantile at a level on the grid (to 1e-9), else the line between its neighbours; a level outside the grid is refused."""
    for k, own in enumerate(levels):
        if abs(own - wanted) <= 1e-9:
            return F.element_at(q, k + 1)
    if not levels[0] < wanted < levels[-1]:
        raise ValueError(f"level {wanted} lies outside the grid")
    k = max(i for i, own in enumerate(levels) if own < wanted)
    share = (wanted - levels[k]) / (levels[k + 1] - levels[k])
    low, high = F.element_at(q, k + 1), F.element_at(q, k + 2)
    return low + share * (high - low)


def units_for(demand: Column, inputs: DecisionInputs) -> Column:
    return F.ceil(F.greatest(demand, F.lit(0.0)) / inputs.demand_per_unit - 1e-9)


def realised_cost(staffed: Column, needed: Column, inputs: DecisionInputs) -> Column:
    over, under = F.greatest(staffed - needed, F.lit(0)), F.greatest(needed - staffed, F.lit(0))
    return inputs.cost_over * over + inputs.cost_under * under


def staffing(forecasts: DataFrame, levels, inputs: DecisionInputs = DecisionInputs(), service_levels=None) -> DataFrame:
    """``model, service_level, origin, units, oracle_units, cost``: sums over areas, means over steps. Rows need ``q, y``.

    The service levels are those of the inputs unless others are given.
    """
    areas = forecasts.filter(F.col("level") == "area")
    need = units_for(F.col("y"), inputs)
    each = F.array(*(F.struct(F.lit(s).alias("service_level"), units_for(demand_at(F.col("q"), levels, s), inputs).alias("units")) for s in service_levels or inputs.levels))
    rows = areas.select("model", "origin", "node", "step", need.alias("need"), F.explode(each).alias("s")).select("model", "origin", "step", "need", "s.*")
    cost = realised_cost(F.col("units"), F.col("need"), inputs)
    daily = rows.groupBy("model", "service_level", "origin", "step").agg(F.sum("units").alias("units"), F.sum("need").alias("oracle_units"), F.sum(cost).alias("cost"))
    return daily.groupBy("model", "service_level", "origin").agg(*(F.avg(c).alias(c) for c in ("units", "oracle_units", "cost")))


def naive_demand(panel: DataFrame, origins: DataFrame, schedule: Schedule, service_levels) -> DataFrame:
    """``origin, node, step, service_level, demand``: the seasonal naive asked for the service levels themselves, for areas."""
    areas = panel.filter(F.col("level") == "area")
    found = naive.seasonal_naive(areas, origins, schedule, service_levels)
    each = F.arrays_zip(F.array(*(F.lit(float(s)) for s in service_levels)).alias("service_level"), F.col("q").alias("demand"))
    return found.select("origin", "node", "step", F.explode(each).alias("d")).select("origin", "node", "step", "d.service_level", "d.demand")


def service_quantile(bands: Column, levels, wanted: float) -> Column:
    """Demand at a service level from a few exported bands: on the line between the two around it, held inside the outermost."""
    check_levels(levels)
    held = min(max(wanted, levels[0]), levels[-1])
    k = max(i for i in range(len(levels) - 1) if i == 0 or levels[i] < held)
    low, high = F.element_at(bands, k + 1), F.element_at(bands, k + 2)
    return low + (held - levels[k]) / (levels[k + 1] - levels[k]) * (high - low)
