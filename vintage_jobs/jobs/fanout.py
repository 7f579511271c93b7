"""Fan-out of small fits: Spark deals panels, batches of vintages and specifications to groups.

Whatever is a sum over rows (unit-root tests, selection) is made by windows and grouped sums, and only small systems are
solved in Python. The other fits get a panel once a specification and batch of as-ofs, not once an as-of.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from vintage_jobs.functions.scalars import choice, chosen_value
from vintage_jobs.jobs import fits
from vintage_jobs.operators.evaluate import expanding_ar1
from vintage_jobs.operators.running import previous, running
from vintage_jobs.operators.vintage import asof_array
from vintage_jobs.sources.store import stored


def fanned_out(rows: DataFrame, *keys: str) -> GroupedData:
    """Groups of heavy fits, in four times as many tasks as a shuffle has: rows are few, so tasks must not be merged by size."""
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).groupBy(*keys)


def unit_root_tests(panel: DataFrame, alpha: float = 0.05) -> DataFrame:
    """panel_id, series_id, p_value, stationary; null p-values are not stationary.

    A series needs 25 values and three different ones. Windows give every row its lagged differences and grouped sums the
    normal equations of all lags, in one shuffle; only the solution of these few sums a series is numpy. Of the panel, one
    number reaches the driver: the rows of the longest series, which bounds the lags.
    """
    keys, size = ["panel_id", "series_id"], lambda n: 12 * (n / 100) ** 0.25
    longest = panel.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    of = Window.partitionBy(*keys)
    by = of.orderBy(F.col("v").isNull(), "period")
    rows = panel.select(*keys, "period", F.when(~F.isnan("value"), F.col("value").cast("double")).alias("v"))
    rows = rows.select("*", F.count("v").over(of).alias("n"), F.avg("v").over(of).alias("mean"), F.min("v").over(of).alias("lo"), F.max("v").over(of).alias("hi"), (F.row_number().over(by) - 2).alias("r"), F.lag("v").over(by).alias("before"))
    most = F.greatest(F.lit(0), F.least(F.ceil(size(F.col("n"))), F.floor(F.col("n") / 2) - 2)).cast("int")
    rows = rows.withColumns({"most": most, "d": F.col("v") - F.col("before"), "y": F.col("before") - F.col("mean")})
    lags = F.reverse(F.collect_list("d").over(by.rowsBetween(-math.ceil(size(longest)), 0)))
    rows = rows.withColumn("lags", F.when(F.col("d").isNotNull(), F.slice(lags, 1, F.col("most") + 1)))
    k, r, y, d = F.col("k"), F.col("r"), F.col("y"), F.col("d")
    inner, once = r >= F.col("most"), k.isNull() | (k == 0)
    sums = rows.select("*", F.posexplode_outer("lags").alias("k", "lag")).groupBy(*keys, "k").agg(
        F.max("n").alias("n"),
        F.max("most").alias("most"),
        *(F.sum(F.when(inner, x * F.col("lag"))).alias(name) for name, x in (("a", d), ("c", y), ("s", F.lit(1.0)))),
        *(F.sum(F.when(inner & (k == 0), x)).alias(name) for name, x in (("size", F.lit(1)), ("total", y), ("squares", y * y))),
        F.count_if(once & (F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).alias("between"),
        F.collect_list(F.when((k == 0) & (r < F.col("most")), F.struct("r", "y", "d"))).alias("head"),
        F.collect_list(F.when((k == 0) & (r >= F.col("n") - 1 - F.col("most")), F.struct("r", "d"))).alias("tail"),
    )
    own = sums.groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in ("n", "most", "size", "total", "squares")),
        F.sum("between").alias("between"),
        F.sort_array(F.collect_list(F.when(k.isNotNull(), F.struct("k", "a", "c", "s")))).alias("sums"),
        *(F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("head", "tail")),
    )

    def solve(fit: pd.Series, most: pd.Series, size: pd.Series, total: pd.Series, squares: pd.Series, a: pd.Series, c: pd.Series, s: pd.Series, level: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
        out = []
        for ok, *of in zip(fit, most, size, total, squares, a, c, s, level, head, tail, strict=True):
            try:
                out.append(fits.unit_root_p(int(of[0]), int(of[1]), *of[2:]) if ok else None)
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out, dtype="Float64")

    p = F.pandas_udf(solve, "double")((F.col("n") >= 25) & (F.col("between") > 0), "most", "size", "total", "squares", "sums.a", "sums.c", "sums.s", "head.y", "head.d", "tail.d")
    return own.select(*keys, p.alias("p_value")).withColumn("stationary", F.coalesce(F.col("p_value") <= alpha, F.lit(False)))


def unit_root_tests_in_time(panel: DataFrame, alpha: float = 0.05) -> DataFrame:
    """panel_id, series_id, period, p_value, stationary at each known value: the test of the values up to and with it.

    One running sum a lag and product gives the normal equations of every period; the first rows, which the test leaves
    out, are taken off in the solution, as how many they are depends on the period. Nothing later is used.
    """
    keys, size = ["panel_id", "series_id"], lambda n: 12 * (n / 100) ** 0.25
    known = panel.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "period", F.col("value").cast("double").alias("v"))
    longest = known.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    most_of_all = math.ceil(size(longest))
    of = Window.partitionBy(*keys)
    by = of.orderBy("period")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = known.select("*", F.row_number().over(by).alias("n"), F.lag("v").over(by).alias("before"), F.first("v").over(upto).alias("v1"))
    rows = rows.withColumns({"r": F.col("n") - 2, "d": F.col("v") - F.col("before"), "y": F.col("before") - F.col("v1")})
    # a third value is there from row n3 on
    rows = rows.withColumn("n2", F.min(F.when(F.col("v") != F.col("v1"), F.col("n"))).over(of))
    rows = rows.withColumn("v2", F.max(F.when(F.col("n") == F.col("n2"), F.col("v"))).over(of))
    rows = rows.withColumn("n3", F.min(F.when((F.col("v") != F.col("v1")) & (F.col("v") != F.col("v2")), F.col("n"))).over(of))
    lag = [F.lag("d", k).over(by) if k else F.col("d") for k in range(most_of_all + 1)]
    rows = rows.withColumns({f"d{k}": x for k, x in enumerate(lag)})
    columns = [f"d{k}" for k in range(most_of_all + 1)]
    run = lambda x: F.coalesce(F.sum(x).over(upto), F.lit(0.0))
    head = F.sort_array(F.collect_list(F.when(F.col("r").between(0, most_of_all - 1), F.struct("r", "y", "d"))).over(of))
    rows = rows.select(
        *keys, "period", "n", "n3", head.alias("head"), F.array(*columns).alias("tail"),
        F.array(*(run(F.col("d") * F.col(c)) for c in columns)).alias("a"),
        F.array(*(run(F.col("y") * F.col(c)) for c in columns)).alias("c"),
        F.array(*(run(F.col(c)) for c in columns)).alias("s"),
        run(F.col("y")).alias("total"), run(F.col("y") * F.col("y")).alias("squares"),
    )

    def solve(n: pd.Series, fit: pd.Series, head_y: pd.Series, head_d: pd.Series, tail: pd.Series, a: pd.Series, c: pd.Series, s: pd.Series, total: pd.Series, squares: pd.Series) -> pd.Series:
        out = []
        for n_, ok, y, d, last, a_, c_, s_, t_, q_ in zip(n, fit, head_y, head_d, tail, a, c, s, total, squares, strict=True):
            try:
                out.append(fits.unit_root_p_from_running(int(n_), y, d, last, a_, c_, s_, t_, q_) if ok else None)
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out, dtype="Float64")

    ready = (F.col("n") >= 25) & F.coalesce(F.col("n") >= F.col("n3"), F.lit(False))
    p = F.pandas_udf(solve, "double")("n", ready, "head.y", "head.d", "tail", "a", "c", "s", "total", "squares")
    return rows.select(*keys, "period", p.alias("p_value")).withColumn("stationary", F.coalesce(F.col("p_value") <= alpha, F.lit(False)))


def seasonally_adjusted(panel: DataFrame, chosen: list[str] | None = None, point_in_time: bool = False, buckets: int = 4) -> DataFrame:
    """The panel with the chosen series (all by default) less their seasonal part; the others stay on the JVM side.

    With ``point_in_time`` each value is less the seasonal part that the series up to it gives (none before 36 values), so
    nothing later is used; a series then goes once to each of ``buckets`` groups, which take every ``buckets``-th value.
    """
    keys, ways = ["panel_id", "series_id"], buckets if point_in_time else 1

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("period")
        values = own["value"].to_numpy(float)
        if point_in_time:
            at = np.arange(own["bucket"].iloc[0], len(values), ways)
            own, values = own.iloc[at], np.array([fits.adjusted(values[: i + 1])[-1] for i in at], float)
        else:
            values = fits.adjusted(values)
        return own[[*keys, "period"]].assign(value=pd.array(values, dtype="Float64"))

    picked = panel if chosen is None else panel.where(F.col("series_id").isin(chosen))
    dealt = picked.select(*keys, "period", "value", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("bucket"))
    made = fanned_out(dealt, *keys, "bucket").applyInPandas(lambda pdf: fit(pdf), "panel_id string, series_id string, period date, value double")
    made = made.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return made if chosen is None else made.unionByName(panel.where(~F.col("series_id").isin(chosen)).select(made.columns))


def _products(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d + 2) for j in range(i, d + 2)]


def selected_forecasts(losses: DataFrame, d: int = 1, h: float = 0.2, min_train: int | DataFrame = 40) -> DataFrame:
    """Adds mu_hat, sigma_hat, choice and y_selected to loss differences; dates without one keep their row, joined by date.

    ``min_train`` is one number, or panel_id and least. The kernel is a quadratic in time, so the normal equations at each
    date are differences of running sums of products with powers of the date's number; only their solution is numpy. The
    sums run in two levels, so a long panel is many tasks.
    """
    key, at = ["panel_id"], "target_period"
    losses = stored(losses, "losses")  # it goes into several steps
    rows = losses.where(F.col("loss_diff").isNotNull()).select("panel_id", at, F.col("loss_diff").alias("v0"))
    for j in range(1, d + 1):
        rows = previous(rows, key, at, {f"l{j}": "v0" if j == 1 else f"l{j - 1}"})
    rows = stored(running(rows, key, at, {"t": ("sum", F.lit(1))}, inclusive=True), "numbered-losses")
    v = [F.col("v0"), F.lit(1.0), *(F.col(f"l{j}") for j in range(1, d + 1))]
    t = F.when(F.col(f"l{d}").isNotNull(), F.col("t").cast("double"))
    sums = {f"g{k}_{i}_{j}": ("sum", v[i] * v[j] * F.pow(t, F.lit(k))) for k in range(5) for i, j in _products(d)}
    newest = [F.col(f"l{j}") for j in range(1, d + 1)]
    before = running(rows, key, at, sums).select(*key, at, "t", F.array(*newest).alias("lags"), F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in sums)).alias("sums"))
    before = stored(before, "loss-sums")
    if isinstance(min_train, DataFrame):
        before = before.join(min_train.select("panel_id", "least"), key)
    else:
        before = before.withColumn("least", F.lit(min_train))
    n = F.col("t") - 1
    start = F.floor(n * (1 - h))  # the kernel is zero up to here
    span = n - F.greatest(start, F.lit(d))
    asked = before.where((n >= F.greatest(F.col("least"), F.lit(max(30, d + 10)))) & (span >= max(10, 3 * (d + 1)))).withColumns({"n": n, "__from": start + 1})
    upto = before.select(*key, F.col("t").alias("__from"), F.col("sums").alias("gone"))

    def solve(sums: pd.Series, gone: pd.Series, n: pd.Series, lags: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, size, own in zip(sums, gone, n, lags, strict=True):
            grams = np.zeros((5, d + 2, d + 2))
            for k in range(5):
                for value, (i, j) in zip((np.asarray(x) - np.asarray(y))[k * len(_products(d)) :], _products(d), strict=False):
                    grams[k, i, j] = grams[k, j, i] = value
            try:
                out.append(fits.expected_loss(grams, int(size), np.asarray(own, float), h))
            except np.linalg.LinAlgError:
                out.append((None, None))
        return pd.DataFrame(out, columns=["mu_hat", "sigma_hat"], dtype="Float64")

    # the loss before a date is the newest lag: those of the date's own row
    found = F.pandas_udf(solve, "mu_hat double, sigma_hat double")("sums", "gone", "n", "lags")
    mu = asked.join(upto, [*key, "__from"]).select(*key, at, found.alias("f")).select(*key, at, "f.*")
    out = losses.join(mu, [*key, at], "left").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("mu_hat", "sigma_hat")}).withColumn("choice", choice(F.col("mu_hat")))
    return out.withColumn("y_selected", chosen_value(F.col("choice"), F.col("y_a"), F.col("y_b")))


def boosted_backtest(rows: DataFrame, min_train: int = 25, buckets: int = 4, **options) -> DataFrame:
    """One forecast for each target with at least ``min_train`` before it, from rows (panel_id, target_period, y, y_lag1, x).

    ``y_pred_ar1`` is the forecast of an autoregression on the same targets. A panel's rows go once to each of ``buckets`` groups, which take every ``buckets``-th origin: not a copy an origin.
    """
    schema = "panel_id string, target_period date, y_true double, y_pred double, n_train int, n_trees int"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("target_period").reset_index(drop=True)
        y = pdf["y"].to_numpy(float)
        x = np.column_stack([np.array([np.array(v, float) for v in pdf["x"]]), pdf["y_lag1"].to_numpy(float)])
        out = []
        for i in range(max(min_train, 1), len(y)):
            if i % buckets == pdf["bucket"].iloc[0]:
                scale = max(float(np.nanmax(np.abs(y[:i]))), 1e-12)  # known at the origin
                pred, trees, _ = fits.boosted_forecast(x[:i] / scale, y[:i] / scale, x[i] / scale, x.shape[1] - 1, seed=i, **options)
                out.append((pdf["panel_id"].iloc[0], pdf["target_period"].iloc[i], y[i], pred * scale, i, trees))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    dealt = rows.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = fanned_out(dealt, "panel_id", "bucket").applyInPandas(lambda pdf: fit(pdf), schema)
    ar1 = expanding_ar1(rows.select("panel_id", "target_period", "y"), least=min_train).select("panel_id", "target_period", F.col("y_pred").alias("y_pred_ar1"))
    out = out.join(ar1, ["panel_id", "target_period"], "left")
    error = F.col("y_true") - F.col("y_pred")
    return out.withColumns({"error": error, "error_ar1": F.col("y_true") - F.col("y_pred_ar1"), "abs_error": F.abs(error), "squared_error": error * error})


def _months(days: pd.Series | list) -> np.ndarray:
    return np.array(pd.to_datetime(pd.Series(days)), "datetime64[M]").astype(np.int64)


def _wide(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The panel of a group as periods by series, its months and its series."""
    wide = pdf.pivot_table(index="period", columns="series_id", values="value", dropna=False, aggfunc="first").sort_index()
    return wide.to_numpy(float), _months(list(wide.index)), list(wide.columns)


def _standard(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each series of each item less its mean over its deviation (one where that is zero), and these."""
    known = ~np.isnan(y)
    n = np.maximum(known.sum(axis=-2), 1)
    mean = np.nansum(y, axis=-2) / n
    sd = np.sqrt(np.nansum((y - mean[..., None, :]) ** 2, axis=-2) / n)
    sd[sd == 0] = 1.0
    return (y - mean[..., None, :]) / sd[..., None, :], mean, sd


def in_batches(asked: DataFrame, order: str, items: list[str], name: str, size: int) -> DataFrame:
    """panel_id and an array ``name`` of at most ``size`` consecutive rows of ``asked`` each: what one group of fits shares."""
    place = F.row_number().over(Window.partitionBy("panel_id").orderBy(order)) - 1
    dealt = asked.withColumn("batch", F.floor(place / size).cast("int"))
    return dealt.groupBy("panel_id", "batch").agg(F.sort_array(F.collect_list(F.struct(order, *items))).alias(name))


def factor_mixture(panel: DataFrame, lag_months: DataFrame, as_ofs: DataFrame, specs: DataFrame, target: str, phase: int = 0, most: int = 40, add_mu: bool = False, every: int = 3, batch: int = 12, default: int = 0) -> DataFrame:
    """Now- and backcast of each specification on each vintage, as forecast records.

    A panel goes once to each specification and batch of ``batch`` as-ofs; the batch's vintages (rows up to the as-of, cells
    up to its month less the series' lag) are masks over it and are fitted together. The target period is the vintage's next
    month in phase (of ``every`` months) and the one before it; a prediction needs that month in the vintage. ``as_ofs`` hold
    for all panels unless they have a panel_id. The common part leaves out the fitted mean unless ``add_mu``.
    """
    schema = "panel_id string, as_of date, model_id string, y_now double, y_back double, loglik double, ok boolean, converged boolean, error string"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        days = [x["as_of"] for x in one.asked]
        blank = {"panel_id": one.panel_id, "model_id": one.model_id, "y_now": None, "y_back": None, "loglik": None, "ok": False, "converged": False, "error": None}
        out = [blank | {"as_of": d} for d in days]
        try:
            y, months, series = _wide(pdf)
            r, i, lag = int(one.r), series.index(target), pdf.groupby("series_id").lag.first().loc[series].to_numpy()
            at, periods = _months(days), np.array([(months <= m).sum() for m in _months(days)])
            if r > min(periods.min(), len(series)):
                raise ValueError("more factors than the panel allows")
            z, mean, sd = _standard(np.where(months[None, :, None] <= at[:, None, None] - lag[None, None, :], y[None], np.nan)[:, : periods.max()])
            model = fits.factor_models(z, periods, r, int(one.p), most)
            common = np.einsum("btr,br->bt", model["state"][..., :r], model["loading"][:, i]) + (model["mu"][:, i, None] if add_mu else 0.0)
            for k, row in enumerate(out):
                now = at[k] + (phase - (at[k] % 12 + 1)) % every
                for name, when in (("y_now", now), ("y_back", now - every)):
                    found = np.flatnonzero(months[: periods[k]] == when)
                    row[name] = float(common[k, found[0]] * sd[k, i] + mean[k, i]) if len(found) else None
                row |= {"loglik": float(model["loglik"][k]), "ok": bool(np.isfinite(model["loglik"][k])), "converged": bool(model["converged"][k])}
        except (ValueError, np.linalg.LinAlgError) as e:
            for row in out:
                row["error"] = str(e)
        return pd.DataFrame(out)[[c.split()[0] for c in schema.split(", ")]]

    asked = as_ofs if "panel_id" in as_ofs.columns else panel.select("panel_id").distinct().withColumn("as_of", F.explode(asof_array(as_ofs)))
    own = panel.join(lag_months.select("series_id", "lag"), "series_id", "left").withColumn("lag", F.coalesce("lag", F.lit(default)))
    own = own.join(in_batches(asked, "as_of", [], "asked", batch), "panel_id").withColumn("spec", F.explode(_as_array(specs)))
    rows = own.select("panel_id", "series_id", "period", "value", "lag", "asked", "batch", "spec.*")
    return fanned_out(rows, "panel_id", "batch", "model_id", "r", "p").applyInPandas(lambda pdf: fit(pdf), schema)


def _as_array(specs: DataFrame) -> Column:
    """A grid of specifications (model_id, r, p) as one value."""
    return specs.agg(F.sort_array(F.collect_list(F.struct("model_id", "r", "p")))).scalar()


def factor_backtest(panel: DataFrame, target: str, min_months: int = 60, k_max: int = 6, most: int = 40, batch: int = 12) -> DataFrame:
    """panel_id, target_period, k, aic, bic, y_true, y_pred: a factor model a factor count for each target with enough months
    before it, on all data up to the month before; series without variation are left out. The best count by criterion is
    then a min_by (see combine.best_by_criterion). Targets are fitted in batches, as in ``factor_mixture``."""
    schema = "panel_id string, target_period date, k int, n_months int, y_true double, y_pred double, loglik double, aic double, bic double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        k, out = int(one.k), []
        y, months, series = _wide(pdf)
        if target in series:
            i, at = series.index(target), _months([x["target_period"] for x in one.asked])
            periods = np.array([(months < m).sum() for m in at])
            own = np.where(months[None, :, None] < at[:, None, None], y[None], np.nan)[:, : max(1, periods.max())]
            known = ~np.isnan(own)
            vary = np.nanmax(np.where(known, own, -np.inf), axis=1) > np.nanmin(np.where(known, own, np.inf), axis=1)
            z, mean, sd = _standard(np.where(vary[:, None, :], own, np.nan))
            rows, width = (~np.isnan(z)).any(axis=2).sum(axis=1), vary.sum(axis=1)
            fitted = vary[:, i] & (periods >= min_months) & (rows >= 5) & (width >= 2) & (k <= np.minimum(rows, width))
            try:
                b = np.flatnonzero(fitted)
                model = fits.factor_models(z[b], periods[b], k, 1, most) if len(b) else None
                for j, b in enumerate(b):
                    steps = max(1, int(at[b] - months[periods[b] - 1]))
                    state = np.linalg.matrix_power(model["blocks"][j], steps) @ model["state"][j, periods[b] - 1, :k]
                    pred = float((model["loading"][j, i] @ state + model["mu"][j, i]) * sd[b, i] + mean[b, i])
                    n, line, free = int((~np.isnan(z[b])).sum()), float(model["loglik"][j]), int(width[b]) * (k + 2) + k * k + k * (k + 1) // 2
                    out.append((one.panel_id, one.asked[b]["target_period"], k, int(periods[b]), float(one.asked[b]["y"]), pred, line, 2 * free - 2 * line, math.log(n) * free - 2 * line))
            except np.linalg.LinAlgError:
                out = []
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    targets = panel.where((F.col("series_id") == target) & F.col("value").isNotNull()).select("panel_id", F.col("period").alias("target_period"), F.col("value").alias("y"))
    first = panel.groupBy("panel_id").agg(F.min("period").alias("first"))
    wanted = targets.join(first, "panel_id").where(F.months_between("target_period", "first") >= min_months).drop("first")
    asked = in_batches(wanted, "target_period", ["y"], "asked", batch).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k_max))))
    rows = panel.join(asked, "panel_id").where(F.col("period") < F.array_max("asked.target_period"))
    return fanned_out(rows, "panel_id", "batch", "k").applyInPandas(lambda pdf: fit(pdf), schema)
