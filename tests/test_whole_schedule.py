"""Registered queries cover every origin, anchor day and scoring level."""

import pytest
from pyspark.sql import functions as F
from ramify.config import DEFAULT, SCORING
from ramify.operators import design
from ramify.plans import backtest as bt
from ramify.plans import catalogue


@pytest.mark.parametrize("name", ["gbm_scale", "naive_quantiles", "naive_residual_quantiles", "shift_quantiles", "pinball_grid"])
def test_queries_have_every_origin(spark, data, name):
    n = DEFAULT.count(bt.setup(spark, data).n_days)
    rows = catalogue.QUERIES[name](spark, data)
    assert rows.select("origin").distinct().count() == n
    if name == "pinball_grid":
        assert rows.agg(F.min(F.size("pinball")), F.max(F.size("pinball"))).first() == (len(SCORING), len(SCORING))


def test_design_has_every_anchor_day(spark, data):
    days = catalogue.gbm_design(spark, data).select("day_idx").distinct().count()
    assert days == bt.setup(spark, data).n_days - design.LOOKBACK + 1


def test_crps_by_level_is_the_flagship(spark, data):
    both = [{r["level"]: r["crps"] for r in catalogue.QUERIES[q](spark, data).collect()} for q in ("crps_by_level", "naive_backtest_crps")]
    assert both[0] == both[1]


@pytest.mark.parametrize("name", ["ets", "theta", "mstl", "arima"])
def test_statistical_models_have_four_weekly_origins_and_all_levels(spark, data, monkeypatch, name):
    class Seen(Exception):
        pass

    def seen(panel, origins, schedule, levels, models):
        raise Seen(origins.count(), tuple(levels), tuple(models))

    monkeypatch.setattr(catalogue.statistical, "forecast", seen)
    n = (bt.setup(spark, data).n_days - DEFAULT.min_train - DEFAULT.horizon) // 28 + 1
    with pytest.raises(Seen) as caught:
        catalogue.QUERIES[name](spark, data)
    assert caught.value.args == (n, SCORING, (name,))
