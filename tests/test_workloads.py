"""The whole jobs against plain recomputations in pandas."""

import numpy as np
import pandas as pd
import pytest

from tests.brute import expected_losses, unit_root_p
from vintage_jobs.functions import scalars as S
from vintage_jobs.jobs import fanout as J
from vintage_jobs.jobs import fits
from vintage_jobs.jobs import workloads as W

TARGET = "GDP"


def hand_made(months=72):
    rng = np.random.default_rng(3)
    dates = pd.date_range("2000-01-01", periods=months, freq="MS")
    season = 5 * np.sin(np.arange(months) * np.pi / 6)
    walk = 100 + np.cumsum(rng.normal(size=months))
    wide = pd.DataFrame({"noise": rng.normal(size=months), "walk": walk, "rate": np.cumsum(rng.normal(size=months)), "twice": np.exp(np.cumsum(np.cumsum(rng.normal(size=months)) * 0.01)), "seasonal": 50 + season + rng.normal(size=months) * 0.1}, index=dates)
    wide[TARGET] = np.where(dates.month % 3 == 0, 1000 + np.arange(months) * 5 + rng.normal(size=months), np.nan)
    wide.iloc[10, 1] = np.nan
    return wide


def as_panel(spark, wide):
    long = wide.rename_axis("period").reset_index().melt("period", var_name="series_id")
    long["period"] = long["period"].dt.date
    rows = [("p", r.series_id, r.period, None if np.isnan(r.value) else float(r.value)) for r in long.itertuples()]
    return spark.createDataFrame(rows, "panel_id string, series_id string, period date, value double")


def by_hand(wide):
    own = wide.copy()
    own["seasonal"] = fits.adjusted(own["seasonal"].to_numpy())
    out, rules = {}, {}
    for name in own.columns.drop(TARGET):
        v = own[name]
        p = unit_root_p(v.to_numpy())
        logs = np.full(len(v), np.nan) if (v < 0).any() else np.log(v.to_numpy())
        change = pd.Series(logs, own.index).diff()
        if change.count() < 10 and v.count() > 25:
            change = v.diff()
        if p is not None and p <= 0.05:
            rules[name], out[name] = S.RULE_LEVEL, v
        elif name == "rate":
            rules[name], out[name] = S.RULE_DIFF, v.diff()
        else:
            rules[name], out[name] = S.RULE_LOG, change
    seen = own[TARGET].dropna()
    out[TARGET] = np.log(seen).diff().reindex(own.index)
    made = pd.DataFrame(out).iloc[1:].dropna(how="all")
    again = [c for c in made.columns if c != TARGET and not ((unit_root_p(made[c].to_numpy()) or 1.0) <= 0.05)]
    made[again] = made[again].diff()
    made = made.iloc[1:]
    return rules, again, made, (made - made.mean()) / made.std(ddof=0)


def test_model_ready_panel(spark):
    wide = hand_made()
    rules, again, want, z = by_hand(wide)
    got, decided = W.model_ready_panel(as_panel(spark, wide), TARGET, ["seasonal"], [], ["rate"])
    got = got.toPandas().assign(period=lambda d: pd.to_datetime(d.period))
    for column, expected in (("value", want), ("z", z)):
        made = got.pivot(index="period", columns="series_id", values=column).astype(float)
        pd.testing.assert_frame_equal(made[sorted(expected)], expected[sorted(expected)], check_names=False, check_freq=False, rtol=1e-6)
    found = {r.series_id: r for r in decided.collect()}
    assert {s: found[s].rule for s in rules} == rules and found[TARGET].rule == S.RULE_TARGET
    assert sorted(s for s in rules if not found[s].stationary_then) == sorted(again)


def test_mixture_over_time(spark):
    as_ofs = pd.to_datetime(["2001-03-31", "2001-04-30", "2001-06-30"])
    rng = np.random.default_rng(1)
    rows = []
    for d in as_ofs:
        for k in range(4):
            ok = not (k == 3 and d.month == 4)
            now = float(rng.normal() * 3) if ok and d.month % 3 == 0 else None
            rows.append(("p", d.date(), f"m{k}", now, float(rng.normal() * 3) if ok else None, ok, None if ok else "singular"))
    rows.append(("empty", as_ofs[0].date(), "m0", None, None, True, None))
    made = spark.createDataFrame(rows, "panel_id string, as_of date, model_id string, y_now double, y_back double, ok boolean, error string")
    truth = {"2000-12-01": -1.0, "2001-03-01": 1.5, "2001-06-01": 0.5}
    targets = spark.createDataFrame([("p", pd.Timestamp(d).date(), y) for d, y in truth.items()], "panel_id string, target_period date, y double")
    for then in (False, True):
        got = {pd.Timestamp(r.as_of): r for r in W.mixture_over_time(made, targets, made.select("as_of").distinct(), then).collect()}
        assert set(got) == set(as_ofs)
        for d in as_ofs:
            known = [y for t, y in truth.items() if not then or pd.Timestamp(t) <= d]
            clip = lambda v: min(max(v, min(known)), max(known))  # noqa: E731, B023
            own = [r for r in rows if r[0] == "p" and pd.Timestamp(r[1]) == d]
            now, back = [clip(r[3]) for r in own if r[3] is not None], [clip(r[4]) for r in own if r[4] is not None]
            r = got[d]
            assert r.mix_backcast == pytest.approx(np.mean(back)) and r.n_components_back == len(back) and r.n_components_now == len(now)
            assert r.mix_nowcast == (pytest.approx(np.mean(now)) if now else None)
            assert r.true_back == truth.get(str(r.q_back)) and r.true_now == (truth[str(r.q_now)] if now else None)


def test_trees_do_not_look_ahead(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=18) * 10
    x = rng.normal(size=(18, 2))

    def run(values):
        rows = [("a", pd.Timestamp(2000 + i, 1, 1).date(), float(v), float(values[i - 1]) if i else None, x[i].tolist()) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, "panel_id string, target_period date, y double, y_lag1 double, x array<double>")
        return [r.y_pred for r in J.boosted_backtest(frame, min_train=12, buckets=2, rounds=20, leaf=2, split=4).orderBy("target_period").collect()]

    later = y.copy()
    later[16:] *= 1000
    assert run(y)[:4] == pytest.approx(run(later)[:4], rel=1e-12)


def test_selection_and_metrics(spark):
    rng = np.random.default_rng(2)
    dates = pd.date_range("1990-01-01", periods=90, freq="QS")
    y = rng.normal(size=90)
    rows = []
    for i, d in enumerate(dates):
        rows += [("p", "a", d.date(), float(y[i]), float(y[i] + rng.normal())), ("p", "b", d.date(), float(y[i]), None if i == 5 else float(y[i] + 0.5 * rng.normal()))]
    frame = spark.createDataFrame(rows, "panel_id string, model_id string, target_period date, y_true double, y_pred double")
    chosen, metrics, counts = W.evaluation(frame, "a", "b")
    got = chosen.orderBy("target_period").toPandas()
    loss = got.loss_diff.dropna().to_numpy()
    mu, sigma = expected_losses(loss, min_train=40)
    known = got.loss_diff.notna().to_numpy()
    np.testing.assert_allclose(got.mu_hat[known].to_numpy(float), mu, rtol=1e-6)
    np.testing.assert_allclose(got.sigma_hat[known].to_numpy(float), sigma, rtol=1e-5)
    picked = np.where(got.choice == "modelA", got.y_a, np.where(got.choice == "modelB", got.y_b, np.nan)).astype(float)
    np.testing.assert_allclose(got.y_selected.to_numpy(float), picked)
    error = (got.y_true - picked)[~np.isnan(picked)]
    row = {r.model_id: r for r in metrics.collect()}
    assert row["selected"].n == len(error) > 10 and row["selected"].fmse == pytest.approx(float(np.mean(error**2))) and row["selected"].last_rmse == pytest.approx(row["selected"].frmse)
    assert {r.choice: r.n for r in counts.collect()} == got.choice.value_counts().to_dict()
