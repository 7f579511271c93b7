"""The registered fits run over the whole job: all specifications, rounds, lags and as-ofs."""

import inspect

import numpy as np
import pytest

from vintage_jobs.jobs import fanout as J
from vintage_jobs.jobs import fits
from vintage_jobs.jobs.registry import CORE


class Asked(Exception):
    pass


@pytest.mark.parametrize("name, called", [("x4_boosted_backtest", "boosted_backtest"), ("x5_factor_mixture", "factor_mixture"), ("x6_factor_backtest", "factor_backtest")])
def test_whole_job_is_registered(spark, small_dir, monkeypatch, name, called):
    takes = inspect.signature(getattr(J, called))

    def stop(*args, **options):
        raise Asked(takes.bind(*args, **options))

    monkeypatch.setattr(J, called, stop)
    with pytest.raises(Asked) as asked:
        CORE[name].query(spark, small_dir)
    bound = asked.value.args[0]
    bound.apply_defaults()
    own = bound.arguments
    if called == "boosted_backtest":
        options = {p.name: p.default for p in inspect.signature(fits.boosted_forecast).parameters.values()} | own["options"]
        assert (options["rounds"], options["patience"], options["rate"]) == (3000, 50, 0.02)
        assert {len(r.x) % 13 for r in own["rows"].collect()} == {0}
    elif called == "factor_mixture":
        assert own["most"] == 40 and {(r.r, r.p) for r in own["specs"].collect()} == {(r, p) for r in range(2, 6) for p in range(1, 4)}
        months = {r.panel_id: r["count"] for r in own["panel"].select("panel_id", "period").distinct().groupBy("panel_id").count().collect()}
        made = {r.panel_id: r["count"] for r in own["as_ofs"].groupBy("panel_id").count().collect()}
        assert made == {k: n - 59 for k, n in months.items() if n >= 60}
    else:
        assert own["k_max"] == 6 and own["most"] == 40


def test_autoregression_beside_the_trees(spark):
    y = np.cumsum(np.random.default_rng(0).normal(size=16)) + 20
    rows = [("a", f"20{i:02d}-01-01", float(v), float(y[i - 1]) if i else None, [float(i), 1.0]) for i, v in enumerate(y)]
    rows = spark.createDataFrame(rows, "panel_id string, target_period string, y double, y_lag1 double, x array<double>").selectExpr("panel_id", "to_date(target_period) AS target_period", "y", "y_lag1", "x")
    got = J.boosted_backtest(rows, min_train=12, buckets=2, rounds=2, leaf=3, split=6).orderBy("target_period").collect()
    for i, r in zip(range(12, 16), got, strict=True):
        slope, level = np.polyfit(y[: i - 1], y[1:i], 1)
        assert r.y_pred_ar1 == pytest.approx(level + slope * y[i - 1]) and r.error_ar1 == pytest.approx(r.y_true - r.y_pred_ar1)
