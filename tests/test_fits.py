import numpy as np
import pytest

from tests.brute import expected_losses, unit_root_p
from vintage_jobs.jobs import fits as X
from vintage_jobs.jobs.fanout import factor_backtest, factor_mixture, seasonally_adjusted, selected_forecasts, unit_root_tests, unit_root_tests_in_time
from vintage_jobs.jobs.fixtures import observations
from vintage_jobs.jobs.registry import CORE


def test_unit_root_tests_against_regressions(spark):
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=200), np.cumsum(rng.normal(size=200))
    gap, steps = noise.copy(), np.round(np.cumsum(rng.normal(size=60)))
    gap[[0, 3, 199]] = np.nan
    series = {"noise": noise, "walk": walk + 1e4, "gap": gap, "steps": steps, "large": 2e6 + 5e5 * noise[:79], "month": rng.normal(size=25) + 50, "long": np.convolve(rng.normal(size=1500), [1, 0.6, -0.4], "valid")}
    none = {"flat": np.ones(50), "two": np.arange(50.0) % 2, "short": noise[:20], "null": np.full(40, np.nan), "one": np.ones(1), "endless": np.append(noise[:40], np.inf)}
    rows = [("p", name, i, None if i % 2 and np.isnan(v) else float(v)) for name, y in (series | none).items() for i, v in enumerate(y)]
    made = spark.createDataFrame(rows, "panel_id string, series_id string, at int, value double").selectExpr("panel_id", "series_id", "add_months(date'1900-01-01', at) AS period", "value", "1 AS n", "'x' AS most")
    got = {r.series_id: r for r in unit_root_tests(made).collect()}
    assert set(got) == set(series | none)
    for name, y in series.items():
        assert got[name].p_value == pytest.approx(unit_root_p(y), rel=1e-6, abs=1e-9), name
        assert got[name].stationary == (unit_root_p(y) <= 0.05)
    assert all(got[name].p_value is None and not got[name].stationary for name in none)
    assert got["noise"].p_value < 0.01 and got["walk"].p_value > 0.05
    assert X.approximate_p(-2.86) == pytest.approx(0.0502, abs=1e-4)
    assert unit_root_tests(made.where("false")).count() == 0


def test_unit_root_query_against_regressions(spark, small_dir):
    cells = {}
    for r in observations(spark, small_dir).where("value IS NOT NULL").orderBy("period").collect():
        cells.setdefault((r.panel_id, r.series_id), []).append(r.value)
    got = {(r.panel_id, r.series_id): r.p_value for r in CORE["x1_unit_root_tests"].query(spark, small_dir).collect()}
    assert set(got) >= set(cells)
    for key, values in cells.items():
        want = unit_root_p(np.array(values))
        assert got[key] is None if want is None else got[key] == pytest.approx(want, rel=1e-6, abs=1e-12), key


def test_seasonal_part_of_a_sine():
    t = np.arange(120)
    wave = np.sin(2 * np.pi * t / 12)
    assert np.abs(X.seasonal_part(0.1 * t + wave) - wave).max() < 0.05
    short = np.arange(30.0)
    assert (X.adjusted(short) == short).all()
    holes = 0.1 * t + wave
    holes[5] = np.nan
    assert np.isnan(X.adjusted(holes)[5])


@pytest.mark.parametrize("buckets", [1, 5])
def test_adjustment_in_time_uses_nothing_later(spark, buckets):
    t = np.arange(64)
    wave = np.where(t < 50, 5 * np.sin(2 * np.pi * t / 12), 5 * np.cos(2 * np.pi * t / 12)) + 0.1 * t
    wave[40] = np.nan
    series = {"wave": wave, "short": np.arange(20.0), "other": t * 2.0, "none": np.full(40, np.nan)}
    rows = [("p", name, i, None if np.isnan(v) else float(v)) for name, y in series.items() for i, v in enumerate(y)]
    frame = spark.createDataFrame(rows, "panel_id string, series_id string, at int, value double").selectExpr("panel_id", "series_id", "add_months(date'1990-01-01', at) AS period", "value", "0 AS bucket")
    got = {}
    for r in seasonally_adjusted(frame, ["wave", "short", "none"], True, buckets).orderBy("period").collect():
        got.setdefault(r.series_id, []).append(np.nan if r.value is None else r.value)
    for name, y in series.items():
        want = y if name == "other" else [X.adjusted(y[: i + 1])[-1] for i in range(len(y))]
        np.testing.assert_allclose(got[name], want, rtol=1e-9)
    assert got["wave"][:35] == list(wave[:35]) and abs(got["wave"][45] - wave[45]) > 1
    assert seasonally_adjusted(frame.where("false"), point_in_time=True).count() == 0


def test_selection_against_weighted_regressions(spark):
    rng = np.random.default_rng(1)
    series = {"short": rng.normal(size=44), "long": np.cumsum(rng.normal(size=160)) * 1e4 + 3e5, "small": rng.normal(size=70) * 1e-3}
    months = np.arange("1990-01", "2010-01", dtype="datetime64[M]")
    rows = [(name, months[i].astype("datetime64[D]").astype(object), 1.0, 2.0, 3.0, None if i % 17 == 5 else float(v)) for name, y in series.items() for i, v in enumerate(y)]
    frame = spark.createDataFrame(rows, "panel_id string, target_period date, y_true double, y_a double, y_b double, loss_diff double")
    for d, h in ((1, 0.2), (2, 0.35)):
        got = {(r.panel_id, r.target_period): r for r in selected_forecasts(frame, d, h, min_train=33).collect()}
        assert len(got) == len(rows)
        for name, y in series.items():
            known = [i for i in range(len(y)) if i % 17 != 5]
            mu, sigma = expected_losses(y[known], d, h, 33)
            made = [got[name, months[i].astype("datetime64[D]").astype(object)] for i in known]
            assert [r.mu_hat is None for r in made] == np.isnan(mu).tolist()
            assert [r.mu_hat for r in made if r.mu_hat is not None] == pytest.approx(mu[~np.isnan(mu)], rel=1e-5, abs=1e-8)
            assert [r.sigma_hat for r in made if r.mu_hat is not None] == pytest.approx(sigma[~np.isnan(mu)], rel=1e-4)
    least = spark.createDataFrame([("short", 40), ("long", 100), ("small", 33)], "panel_id string, least int")
    each = selected_forecasts(frame, min_train=least).where("mu_hat IS NOT NULL").groupBy("panel_id").count().collect()
    n = {name: sum(i % 17 != 5 for i in range(len(y))) for name, y in series.items()}
    assert {r.panel_id: r["count"] for r in each} == {"long": n["long"] - 100, "small": n["small"] - 46}  # the kernel spans ten dates from 46 on


def test_unit_root_tests_in_time_against_regressions(spark):
    rng = np.random.default_rng(3)
    series = {"noise": rng.normal(size=90) * 1e5 + 3e6, "walk": np.cumsum(rng.normal(size=140)), "steps": np.round(np.cumsum(rng.normal(size=60))), "late": np.concatenate((np.zeros(30), rng.normal(size=40)))}
    rows = [("p", name, i, None if i == 7 else float(v)) for name, y in series.items() for i, v in enumerate(y)]
    made = spark.createDataFrame(rows, "panel_id string, series_id string, at int, value double").selectExpr("panel_id", "series_id", "add_months(date'1950-01-01', at) AS period", "value", "1 AS n")
    got = {(r.series_id, r.period.year * 12 + r.period.month - 1950 * 12 - 1): r for r in unit_root_tests_in_time(made).collect()}
    for name, y in series.items():
        assert (name, 7) not in got
        for at in (5, 23, 24, 25, 31, 32, 33, 40, 59, len(y) - 1):
            want = unit_root_p(np.delete(y[: at + 1], 7) if at > 7 else y[: at + 1])
            if at < len(y):
                r = got[name, at]
                assert r.p_value is None if want is None else r.p_value == pytest.approx(want, rel=1e-5, abs=1e-9), (name, at)
                assert r.stationary == (want is not None and want <= 0.05)
    last = {r.series_id: r.p_value for r in unit_root_tests(made).collect()}
    assert all(got[name, len(y) - 1].p_value == pytest.approx(last[name], rel=1e-6, abs=1e-9) for name, y in series.items())


def test_boosting_lowers_the_training_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = np.where(x[:, 1] > 0, 1.0, -1.0) + 0.1 * x[:, 0]
    pred, made, errors = X.boosted_forecast(x, y, np.array([0.0, 2.0, 0.0, 0.0]), None, rounds=80, rate=0.1, subsample=1, features=None, share=0)
    assert made == 80 and all(b <= a + 1e-12 for a, b in zip(errors, errors[1:], strict=False)) and pred == pytest.approx(1.0, abs=0.2)
    first = X.boosted_forecast(x, y, x[0], 0, seed=3, rounds=40)
    assert first == X.boosted_forecast(x, y, x[0], 0, seed=3, rounds=40)
    with pytest.raises(ValueError):
        X.boosted_forecast(x[:5], y[:5], x[0], None, share=0.5)


def dense(y, mu, loading, move, shock, noise):
    """Log-likelihood, means and variances of the states by one large Gaussian."""
    n, m = len(y), len(move)
    cov = np.zeros((n * m, n * m))
    p = np.eye(m) * 10
    for t in range(n):
        p = move @ p @ move.T + shock
        block = p
        for s in range(t, n):
            cov[s * m : (s + 1) * m, t * m : (t + 1) * m] = block
            cov[t * m : (t + 1) * m, s * m : (s + 1) * m] = block.T
            block = move @ block
    wide = np.kron(np.eye(n), np.hstack([loading, np.zeros((len(loading), m - loading.shape[1]))]))
    full = wide @ cov @ wide.T + np.diag(np.tile(noise, n))
    seen = ~np.isnan(y.ravel())
    v, f, c = (y - mu).ravel()[seen], full[np.ix_(seen, seen)], cov @ wide.T[:, seen]
    line = -0.5 * (seen.sum() * np.log(2 * np.pi) + np.linalg.slogdet(f)[1] + v @ np.linalg.solve(f, v))
    left = cov - c @ np.linalg.solve(f, c.T)
    return line, (c @ np.linalg.solve(f, v)).reshape(n, m), np.array([left[t * m : (t + 1) * m, t * m : (t + 1) * m] for t in range(n)])


@pytest.mark.parametrize("r, p", [(1, 1), (2, 1), (2, 2)])
def test_smoother_against_the_dense_gaussian(r, p):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(3, 6, 4))
    y[0, 1, 0] = y[1, 2] = y[2, 4:] = np.nan
    mu, loading, noise = rng.normal(size=(3, 4)), rng.normal(size=(3, 4, r)), rng.uniform(0.3, 1, (3, 4))
    blocks, drawn = rng.normal(size=(3, r, r * p)) * 0.3, np.tile(np.eye(r) * 0.4, (3, 1, 1))
    mean, variance, line = X.smoothed(y, mu, loading, noise, blocks, drawn)
    for b in range(3):
        m = r * (p + 1)
        move, shock = np.zeros((m, m)), np.zeros((m, m))
        move[:r, : r * p], move[r:, : r * p], shock[:r, :r] = blocks[b], np.eye(r * p), drawn[b]
        want = dense(y[b], mu[b], loading[b], move, shock, noise[b])
        assert line[b] == pytest.approx(want[0]) and mean[b] == pytest.approx(want[1], abs=1e-9) and variance[b] == pytest.approx(want[2], abs=1e-9)


def simulated(seed=5, length=120):
    rng = np.random.default_rng(seed)
    f = np.zeros(length)
    for t in range(1, length):
        f[t] = 0.8 * f[t - 1] + rng.normal()
    y = np.outer(f, rng.uniform(0.5, 1.5, 8)) + 0.3 * rng.normal(size=(length, 8))
    return f, (y - y.mean(axis=0)) / y.std(axis=0)


def test_factor_models_climb_and_recover():
    f, y = simulated()
    y[100:, 0] = np.nan
    lines = [X.factor_models(y[None], np.array([120]), 1, 2, most=k, tol=0)["loglik"][0] for k in range(8)]
    assert all(b >= a - 1e-6 for a, b in zip(lines, lines[1:], strict=False))
    model = X.factor_models(y[None], np.array([120]), 1, 2)
    assert model["converged"][0] and model["loglik"][0] > model["first"][0]
    assert abs(np.corrcoef(model["state"][0, :, 0], f)[0, 1]) > 0.97


def test_items_of_a_batch_do_not_touch_each_other():
    _, y = simulated()
    both = np.stack([y, y])
    both[0, 80:] = np.nan
    one = X.factor_models(y[None, :80], np.array([80]), 2, 1)
    two = X.factor_models(both, np.array([80, 120]), 2, 1)
    assert two["loglik"][0] == pytest.approx(one["loglik"][0], rel=1e-6) and two["state"][0, :80] == pytest.approx(one["state"][0], abs=1e-5)


def test_a_step_against_plain_regressions():
    """One step from given moments: each series' regression on (1, factors) and the factors' on their past, by sums over periods."""
    _, y = simulated(6, 60)
    y[10:15, 2] = np.nan
    r, p = 2, 2
    start = X.factor_models(y[None], np.array([60]), r, p, most=1, tol=0)
    after = X.factor_models(y[None], np.array([60]), r, p, most=2, tol=0)
    mean, variance, _ = X.smoothed(y[None], start["mu"], start["loading"], start["noise"], start["blocks"], start["innovation"])
    for i in range(8):
        a, b = np.zeros((r + 1, r + 1)), np.zeros(r + 1)
        for t in range(60):
            if not np.isnan(y[t, i]):
                g = np.concatenate(([1.0], mean[0, t, :r]))
                a += np.outer(g, g)
                a[1:, 1:] += variance[0, t, :r, :r]
                b += g * y[t, i]
        assert np.concatenate((after["mu"][0, i : i + 1], after["loading"][0, i])) == pytest.approx(np.linalg.solve(a, b), rel=1e-5, abs=1e-7)
    s = sum(np.outer(mean[0, t], mean[0, t]) + variance[0, t] for t in range(60))
    assert after["blocks"][0] == pytest.approx(np.linalg.solve(s[r:, r:], s[r:, :r]).T, rel=1e-4, abs=1e-6)


def test_mixture_and_backtest_records(spark):
    f, y = simulated(7, 72)
    months = np.arange("2000-01", "2006-01", dtype="datetime64[M]")
    rows = [("p", f"s{i}", months[t].astype("datetime64[D]").astype(object), float(y[t, i])) for t in range(72) for i in range(4) if i or t % 3 == 2]
    panel = spark.createDataFrame(rows, "panel_id string, series_id string, period date, value double")
    lags = spark.createDataFrame([("s0", 1), ("s1", 2)], "series_id string, lag int")
    as_ofs = spark.createDataFrame([(d,) for d in np.array(["2005-05-31", "2005-06-30", "2005-10-31"], "datetime64[D]").astype(object)], "as_of date")
    specs = spark.createDataFrame([("DFM_r1_p1", 1, 1), ("DFM_r9_p1", 9, 1)], "model_id string, r int, p int")
    got = {(str(r.as_of), r.model_id): r for r in factor_mixture(panel, lags, as_ofs, specs, "s0", batch=2).collect()}
    assert len(got) == 6 and all(r.error and not r.ok for (_, m), r in got.items() if m == "DFM_r9_p1")
    # each vintage by itself: rows up to the as-of, cells up to its month less the lag
    wide = np.full((72, 4), np.nan)
    for t in range(72):
        for i in range(4):
            wide[t, i] = y[t, i] if i or t % 3 == 2 else np.nan
    for day, last in (("2005-05-31", 65), ("2005-06-30", 66), ("2005-10-31", 70)):
        own = wide[:last].copy()
        for i, lag in enumerate((1, 2, 0, 0)):
            own[max(0, last - lag) :, i] = np.nan
        mean, sd = np.nanmean(own, axis=0), np.nanstd(own, axis=0)
        model = X.factor_models(((own - mean) / sd)[None], np.array([last]), 1, 1)
        common = model["state"][0, :, 0] * model["loading"][0, 0, 0] * sd[0] + mean[0]
        r, now = got[day, "DFM_r1_p1"], -(-last // 3) * 3 - 1
        assert r.ok and r.y_back == pytest.approx(common[now - 3], rel=1e-3, abs=1e-4)
        assert (r.y_now is None) == (now >= last) and (now >= last or r.y_now == pytest.approx(common[now], rel=1e-3, abs=1e-4))
    back = factor_backtest(panel, "s0", k_max=3, batch=3).collect()
    assert {r.k for r in back} == {1, 2, 3} and all(abs(r.y_pred) < 5 and r.n_months >= 60 and r.bic > r.aic for r in back)
