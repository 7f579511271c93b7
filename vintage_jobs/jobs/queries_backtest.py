"""Registered queries: features, baselines, metrics, mixtures and fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintage_jobs.functions import scalars as S
from vintage_jobs.jobs import fixtures as X
from vintage_jobs.jobs.fixtures import with_tables as W
from vintage_jobs.jobs.registry import CORE
from vintage_jobs.operators import combine as C
from vintage_jobs.operators import evaluate as E
from vintage_jobs.operators import features as T
from vintage_jobs.sources import panels as P


def quarter_targets(spark, sf_dir):
    return T.split_target(X.panel(spark, sf_dir), P.TARGET)


@CORE.add("p1_split_target", W("tq", "SELECT panel_id, target_period, y FROM tq"))
def p1(spark, sf_dir):
    return quarter_targets(spark, sf_dir)[0]


FEAT = "ft AS (SELECT t.panel_id, t.target_period, s.series_id, l.lag, CASE WHEN l.lag >= coalesce(m.lag, 1) THEN g.value END AS x FROM tq t JOIN (SELECT DISTINCT panel_id, series_id FROM grid WHERE series_id <> 'TOTAL') s USING (panel_id) CROSS JOIN (SELECT unnest(range(0, 13))::INTEGER AS lag) l LEFT JOIN mlags m USING (series_id) LEFT JOIN grid g ON g.panel_id = t.panel_id AND g.series_id = s.series_id AND g.period = (t.target_period - (l.lag + 1) * INTERVAL 1 MONTH)::DATE)"


@CORE.add("j5_lagged_features", W("tq grid mlags", "SELECT * FROM ft", FEAT))
def j5(spark, sf_dir):
    targets, predictors = quarter_targets(spark, sf_dir)
    return T.lagged_features(targets, predictors, X.month_lags(spark, sf_dir), rule="mid", max_lag=12)


@CORE.add("j5_supervised_rows", W("tq grid mlags", "SELECT panel_id, target_period, y, lag(y) OVER w AS y_lag1, row_number() OVER w - 1 AS n_train, n_known, round(total, 2) AS total FROM tq LEFT JOIN (SELECT panel_id, target_period, count(x) AS n_known, sum(x) AS total FROM ft GROUP BY ALL) USING (panel_id, target_period) WINDOW w AS (PARTITION BY panel_id ORDER BY target_period) QUALIFY n_known > 0", FEAT))
def j5b(spark, sf_dir):
    targets, predictors = quarter_targets(spark, sf_dir)
    rows = T.supervised_rows(T.lagged_features(targets, predictors, X.month_lags(spark, sf_dir), rule="mid"), targets)
    total = F.aggregate(F.filter("x", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    return rows.select("panel_id", "target_period", "y", "y_lag1", F.col("n_train").cast("long").alias("n_train"), "n_known", F.round(total, 2).alias("total"))


@CORE.add("w5_w10_target_lags", W("tq", "SELECT panel_id, target_period, y, lag(y) OVER w AS y_lag1, row_number() OVER w - 1 AS n_train FROM tq WINDOW w AS (PARTITION BY panel_id ORDER BY target_period)"))
def w5(spark, sf_dir):
    return T.target_lags(quarter_targets(spark, sf_dir)[0]).withColumn("n_train", F.col("n_train").cast("long"))


@CORE.add("w12_chronological_split", W("tq", "SELECT panel_id, target_period, y, row_number() OVER (PARTITION BY panel_id ORDER BY target_period) > count(*) OVER (PARTITION BY panel_id) - greatest(1, floor(count(*) OVER (PARTITION BY panel_id) * 0.2)) AS is_validation FROM tq"))
def w12(spark, sf_dir):
    return T.chronological_split(quarter_targets(spark, sf_dir)[0], 0.2)


@CORE.add("w6_expanding_ar1", W("ar", "SELECT panel_id, target_period, y, round(y_pred, 1) AS y_pred FROM ar"))
def w6(spark, sf_dir):
    return E.expanding_ar1(X.targets(spark, sf_dir)).withColumn("y_pred", F.round("y_pred", 1))


@CORE.add("j9_attach_target", W("grid tm", "SELECT g.panel_id, series_id, period, value, y FROM grid g LEFT JOIN tm ON g.panel_id = tm.panel_id AND g.period = tm.target_period WHERE series_id <> 'TOTAL'"))
def j9(spark, sf_dir):
    panel = X.panel(spark, sf_dir).where("series_id <> 'TOTAL'")
    return panel.join(X.targets(spark, sf_dir).withColumnRenamed("target_period", "period"), ["panel_id", "period"], "left")


@CORE.add("a1_a2_metrics", W("fc", "SELECT panel_id, model_id, count(e) AS n, round(avg(e * e), 0) AS fmse, round(avg(abs(e)), 1) AS mae, round(avg(CASE WHEN e IS NOT NULL THEN y_true * y_true END), 0) AS fmse_zero, round(sqrt(avg(e * e)), 1) AS frmse, round(1 - avg(e * e) / avg(CASE WHEN e IS NOT NULL THEN y_true * y_true END), 6) AS skill FROM (SELECT *, y_true - y_pred AS e FROM fc) GROUP BY panel_id, model_id"))
def a1(spark, sf_dir):
    m = E.metrics(X.forecasts(spark, sf_dir))
    return m.select("panel_id", "model_id", "n", *(F.round(c, d).alias(c) for c, d in (("fmse", 0), ("mae", 1), ("fmse_zero", 0), ("frmse", 1), ("skill", 6))))


@CORE.add("w7_running_rmse", W("fc", "SELECT panel_id, model_id, target_period, round(sqrt(avg(power(y_true - y_pred, 2)) OVER (PARTITION BY panel_id, model_id ORDER BY target_period)), 1) AS rmse FROM fc"))
def w7(spark, sf_dir):
    return E.running_rmse(X.forecasts(spark, sf_dir)).select("panel_id", "model_id", "target_period", F.round("rmse", 1).alias("rmse"))


LOSS = "ls AS (SELECT a.panel_id, a.target_period, a.y_true, a.y_pred AS y_a, b.y_pred AS y_b, power(a.y_true - a.y_pred, 2) - power(b.y_true - b.y_pred, 2) AS loss_diff, abs(a.y_true - a.y_pred) - abs(b.y_true - b.y_pred) AS abs_diff FROM fc a JOIN fc b ON a.panel_id = b.panel_id AND a.target_period = b.target_period WHERE a.model_id = 'ar1' AND b.model_id = 'mean')"


@CORE.add("w8_loss_differences", W("fc", "SELECT panel_id, target_period, y_true, round(y_a, 1) AS y_a, round(y_b, 1) AS y_b, round(abs_diff, 1) AS loss_diff FROM ls", LOSS))
def w8(spark, sf_dir):
    out = E.loss_differences(X.forecasts(spark, sf_dir), "ar1", "mean", "absolute")
    return out.select("panel_id", "target_period", "y_true", *(F.round(c, 1).alias(c) for c in ("y_a", "y_b", "loss_diff")))


@CORE.add("w13_lag_design", W("fc", "SELECT panel_id, target_period, round(d0, 1) AS loss_diff, round(l1, 1) AS lag_1, round(l2, 1) AS lag_2 FROM (SELECT panel_id, target_period, abs_diff AS d0, lag(abs_diff, 1) OVER w AS l1, lag(abs_diff, 2) OVER w AS l2 FROM ls WHERE abs_diff IS NOT NULL WINDOW w AS (PARTITION BY panel_id ORDER BY target_period)) WHERE l2 IS NOT NULL", LOSS))
def w13(spark, sf_dir):
    out = E.lag_design(E.loss_differences(X.forecasts(spark, sf_dir), "ar1", "mean", "absolute"), 2)
    return out.select("panel_id", "target_period", *(F.round(c, 1).alias(c) for c in ("loss_diff", "lag_1", "lag_2")))


CHOICE = "ch AS (SELECT *, CASE WHEN abs_diff IS NULL THEN 'na' WHEN abs(abs_diff) <= 1e-12 THEN 'tie' WHEN abs_diff < 0 THEN 'modelA' ELSE 'modelB' END AS choice FROM ls)"


@CORE.add("f9_choices", W("fc", "SELECT panel_id, target_period, choice, round(CASE choice WHEN 'modelA' THEN y_a WHEN 'modelB' THEN y_b END, 1) AS y_selected FROM ch", f"{LOSS}, {CHOICE}"))
def f9(spark, sf_dir):
    out = E.loss_differences(X.forecasts(spark, sf_dir), "ar1", "mean", "absolute").withColumn("choice", S.choice(F.col("loss_diff")))
    return out.select("panel_id", "target_period", "choice", F.round(S.chosen_value(F.col("choice"), F.col("y_a"), F.col("y_b")), 1).alias("y_selected"))


@CORE.add("a11_choice_counts", W("fc", "SELECT panel_id, choice, count(*) AS n FROM ch GROUP BY ALL", f"{LOSS}, {CHOICE}"))
def a11(spark, sf_dir):
    out = E.loss_differences(X.forecasts(spark, sf_dir), "ar1", "mean", "absolute").withColumn("choice", S.choice(F.col("loss_diff")))
    return E.choice_counts(out)


@CORE.add("j10_forecast_pairs", W("fc", "SELECT panel_id, target_period, max(y_true) AS y_true, round(max(CASE WHEN model_id = 'ar1' THEN y_pred END), 1) AS ar1, round(max(CASE WHEN model_id = 'mean' THEN y_pred END), 1) AS mean FROM fc GROUP BY ALL"))
def j10(spark, sf_dir):
    return X.forecasts(spark, sf_dir).groupBy("panel_id", "target_period").pivot("model_id", ["ar1", "mean"]).agg(F.max("y_true").alias("t"), F.max("y_pred").alias("p")).select("panel_id", "target_period", F.coalesce("ar1_t", "mean_t").alias("y_true"), F.round("ar1_p", 1).alias("ar1"), F.round("mean_p", 1).alias("mean"))


@CORE.add("u1_all_forecasts", W("fc", "SELECT panel_id, model_id, count(*) AS n, count(y_pred) AS n_pred, min(target_period) AS first, max(target_period) AS last FROM fc GROUP BY ALL"))
def u1(spark, sf_dir):
    return X.forecasts(spark, sf_dir).groupBy("panel_id", "model_id").agg(F.count("*").alias("n"), F.count("y_pred").alias("n_pred"), F.min("target_period").alias("first"), F.max("target_period").alias("last"))


@CORE.add("a15_coverage", W("fc", "SELECT panel_id, model_id, count(y_pred) AS n, min(CASE WHEN y_pred IS NOT NULL THEN target_period END) AS first, least(40, greatest(5, count(y_pred) // 2)) AS least FROM fc GROUP BY ALL"))
def a15(spark, sf_dir):
    return E.coverage(X.forecasts(spark, sf_dir))


BOUNDS = "bd AS (SELECT panel_id, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM tm GROUP BY panel_id)"


@CORE.add("a5_bounds", W("tm", "SELECT panel_id, round(lo, 2) AS lo, round(hi, 2) AS hi, (SELECT min(y) FROM tm i WHERE i.panel_id = bd.panel_id) AS least, (SELECT max(y) FROM tm i WHERE i.panel_id = bd.panel_id) AS most FROM bd", BOUNDS))
def a5(spark, sf_dir):
    t = X.targets(spark, sf_dir)
    both = E.bounds(t, low=0.1, high=0.9).join(E.bounds(t, "minmax").withColumnsRenamed({"lo": "least", "hi": "most"}), "panel_id")
    return both.select("panel_id", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"), "least", "most")


@CORE.add("a5_bounds_point_in_time", W("tm asofs", "SELECT p.panel_id, as_of, (SELECT min(y) FROM tm i WHERE i.panel_id = p.panel_id AND target_period <= as_of) AS lo, (SELECT max(y) FROM tm i WHERE i.panel_id = p.panel_id AND target_period <= as_of) AS hi FROM (SELECT DISTINCT panel_id FROM tm) p, asofs"))
def a5_then(spark, sf_dir):
    return E.bounds_in_time(X.targets(spark, sf_dir), X.asofs(spark, sf_dir))


THEN = "bt AS (SELECT p.panel_id, as_of, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM (SELECT DISTINCT panel_id FROM tm) p CROSS JOIN asofs LEFT JOIN tm i ON i.panel_id = p.panel_id AND target_period <= as_of GROUP BY ALL)"


@CORE.add("a5_quantiles_in_time", W("tm asofs", "SELECT panel_id, as_of, round(lo, 2) AS lo, round(hi, 2) AS hi FROM bt", THEN))
def a5_quantiles(spark, sf_dir):
    found = E.bounds_in_time(X.targets(spark, sf_dir), X.asofs(spark, sf_dir), "quantile", 0.1, 0.9)
    return found.select("panel_id", "as_of", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


@CORE.add("a6_mixture_in_time", W("tm asofs upf", "SELECT panel_id, as_of, target_quarter, round(avg(CASE WHEN NOT bad AND value IS NOT NULL THEN least(greatest(value, lo), hi) END) / pi(), 3) AS mixture FROM upf LEFT JOIN bt USING (panel_id, as_of) GROUP BY ALL", THEN))
def a6_in_time(spark, sf_dir):
    bounds = E.bounds_in_time(X.targets(spark, sf_dir), X.asofs(spark, sf_dir), "quantile", 0.1, 0.9)
    return C.mixture(X.updates(spark, sf_dir), bounds).select("panel_id", "as_of", "target_quarter", F.round(F.col("mixture") / F.pi(), 3).alias("mixture"))


@CORE.add("a15_selection_minimum", W("fc", "SELECT panel_id, least(40, greatest(5, count(*) FILTER (WHERE y_true IS NOT NULL AND y_a IS NOT NULL AND y_b IS NOT NULL) // 2))::INTEGER AS least FROM ls GROUP BY panel_id", LOSS))
def a15_minimum(spark, sf_dir):
    return E.selection_minimum(E.loss_differences(X.forecasts(spark, sf_dir), "ar1", "mean"))


@CORE.add("f8_clipped", W("tm upd", "SELECT panel_id, as_of, model_id, round(CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END, 4) AS clipped FROM upd JOIN bd USING (panel_id)", BOUNDS))
def f8(spark, sf_dir):
    b = E.bounds(X.targets(spark, sf_dir), low=0.1, high=0.9)
    return X.updates(spark, sf_dir).join(b, "panel_id").select("panel_id", "as_of", "model_id", F.round(S.clipped(F.col("value"), F.col("lo"), F.col("hi")), 4).alias("clipped"))


@CORE.add("p9_failed_fits", W("upf", "SELECT panel_id, as_of, model_id, bad AS failed FROM upf"))
def p9(spark, sf_dir):
    return C.with_failed(X.updates(spark, sf_dir), strict_reference=True).select("panel_id", "as_of", "model_id", "failed")


MIX = "mx AS (SELECT panel_id, as_of, target_quarter, count(*) FILTER (WHERE use IS NOT NULL) AS n_used, count(*) FILTER (WHERE use IS NULL) AS n_failed, count(*) FILTER (WHERE use <> value) AS n_trimmed, avg(use) AS mean, coalesce(string_agg(CASE WHEN use IS NOT NULL THEN model_id END, ',' ORDER BY model_id), '') AS models_used FROM (SELECT upf.*, CASE WHEN NOT bad AND value IS NOT NULL THEN least(greatest(value, lo), hi) END AS use FROM upf JOIN bd USING (panel_id)) GROUP BY panel_id, as_of, target_quarter)"


def mixtures(spark, sf_dir):
    return C.mixture(X.updates(spark, sf_dir), E.bounds(X.targets(spark, sf_dir), low=0.1, high=0.9))


@CORE.add("a6_mixture", W("tm upf", "SELECT panel_id, as_of, target_quarter, n_used, n_failed, n_trimmed, models_used, round(mean, 5) AS mixture FROM mx", f"{BOUNDS}, {MIX}"))
def a6(spark, sf_dir):
    return mixtures(spark, sf_dir).select("panel_id", "as_of", "target_quarter", "n_used", "n_failed", "n_trimmed", F.array_join("models_used", ",").alias("models_used"), F.round("mixture", 5).alias("mixture"))


CLIP = "least(greatest(value, lo), hi)"


def branch(used: str, failed: str, trimmed: str, value: str, rows: str = "") -> str:
    """SQL of one branch of the mixture: which forecasts are used, failed and trimmed, and its value."""
    own = f"SELECT upf.*, {used} AS used, {failed} AS failed, {trimmed} AS trimmed, CASE WHEN {used} AND value IS NOT NULL THEN {CLIP} END AS use FROM upf JOIN bd USING (panel_id){rows}"
    mixed = f"SELECT panel_id, as_of, target_quarter, count(*) FILTER (WHERE used) AS n_used, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE trimmed) AS n_trimmed, coalesce(string_agg(CASE WHEN used THEN model_id END, ',' ORDER BY model_id), '') AS models_used, avg(use) AS mean FROM ({own}) GROUP BY ALL"
    return f"SELECT panel_id, as_of, target_quarter, n_used, n_failed, n_trimmed, models_used, round({value} / pi(), 3) AS mixture FROM ({mixed}) m"


def branch_rows(mixed):
    return mixed.select("panel_id", "as_of", "target_quarter", "n_used", "n_failed", "n_trimmed", F.array_join("models_used", ",").alias("models_used"), F.round(F.col("mixture") / F.pi(), 3).alias("mixture"))


KEPT = branch("value IS NOT NULL", "bad OR value IS NULL", f"value IS NOT NULL AND value <> {CLIP}", "mean")
STRICT = branch("NOT bad", "bad", f"NOT bad AND (value IS NULL OR value <> {CLIP})", "mean")
FALLBACK = branch("NOT bad AND value IS NOT NULL", "bad OR value IS NULL", f"NOT bad AND value IS NOT NULL AND value <> {CLIP}", "coalesce(mean, (SELECT max(y) FROM tm WHERE tm.panel_id = m.panel_id AND target_period = date_trunc('month', m.as_of)))", " WHERE model_id IN ('DFM_r1_p1', 'DFM_r2_p1')")


def tight(spark, sf_dir):
    return E.bounds(X.targets(spark, sf_dir), low=0.1, high=0.9)


@CORE.add("a6_mixture_keeping_failed", W("tm upf", KEPT, BOUNDS))
def a6_kept(spark, sf_dir):
    """Failed fits that have a number still count."""
    return branch_rows(C.mixture(X.updates(spark, sf_dir), tight(spark, sf_dir), drop_failed=False))


@CORE.add("a6_mixture_strict", W("tm upf", STRICT, BOUNDS))
def a6_strict(spark, sf_dir):
    """A null forecast of a fit that did not fail is listed as used and trimmed."""
    return branch_rows(C.mixture(X.updates(spark, sf_dir), tight(spark, sf_dir), strict_reference=True))


@CORE.add("a6_mixture_with_fallback", W("tm upf", FALLBACK, BOUNDS))
def a6_fallback(spark, sf_dir):
    """Mixtures of two models; where both fail, the total of the month takes their place."""
    own = X.updates(spark, sf_dir).where(F.col("model_id").isin("DFM_r1_p1", "DFM_r2_p1"))
    month = X.targets(spark, sf_dir).select("panel_id", F.last_day("target_period").alias("as_of"), F.col("y").alias("fallback_value"))
    fallback = own.select(*C.UPDATE).distinct().join(month, ["panel_id", "as_of"])
    return branch_rows(C.mixture(own, tight(spark, sf_dir), fallback))


@CORE.add("o2_j7_aligned", W("tm upf", "SELECT t.panel_id, t.target_period, t.y, round(m.y_pred, 5) AS y_pred FROM tm t LEFT JOIN (SELECT panel_id, target_quarter, arg_max(mean, as_of) AS y_pred FROM mx WHERE mean IS NOT NULL GROUP BY ALL) m ON m.panel_id = t.panel_id AND m.target_quarter = t.target_period", f"{BOUNDS}, {MIX}"))
def j7(spark, sf_dir):
    return C.aligned(mixtures(spark, sf_dir), X.targets(spark, sf_dir)).withColumn("y_pred", F.round("y_pred", 5))


@CORE.add("j8_with_truth", W("tm upf", "SELECT mx.panel_id, as_of, target_quarter, round(mean, 5) AS mixture, a.y AS true_now, b.y AS true_back FROM mx LEFT JOIN tm a ON a.panel_id = mx.panel_id AND a.target_period = target_quarter LEFT JOIN tm b ON b.panel_id = mx.panel_id AND b.target_period = (target_quarter - INTERVAL 3 MONTH)::DATE", f"{BOUNDS}, {MIX}"))
def j8(spark, sf_dir):
    return C.with_truth(mixtures(spark, sf_dir), X.targets(spark, sf_dir)).select("panel_id", "as_of", "target_quarter", F.round("mixture", 5).alias("mixture"), "true_now", "true_back")


PREV = "pr AS (SELECT *, lag(value) OVER w AS previous_update, last_value(CASE WHEN NOT bad THEN struct_pack(v := value) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM upf WINDOW w AS (PARTITION BY panel_id, model_id, target_quarter ORDER BY as_of))"


@CORE.add("w9_previous_forecasts", W("upf", "SELECT panel_id, as_of, model_id, round(previous_update, 4) AS previous_update, round(pv.v, 4) AS previous_valid FROM pr", PREV))
def w9(spark, sf_dir):
    return C.with_previous(X.updates(spark, sf_dir)).select("panel_id", "as_of", "model_id", F.round("previous_update", 4).alias("previous_update"), F.round("previous_valid", 4).alias("previous_valid"))


@CORE.add("j11_fallback", W("upf", "SELECT panel_id, as_of, model_id, CASE WHEN NOT bad AND value IS NOT NULL THEN 'ok' WHEN previous_update IS NOT NULL THEN 'previous_update' WHEN pv.v IS NOT NULL THEN 'previous_valid' ELSE 'none' END AS source, round(CASE WHEN NOT bad AND value IS NOT NULL THEN value ELSE coalesce(previous_update, pv.v) END, 4) AS final_value FROM pr", PREV))
def j11(spark, sf_dir):
    return C.with_fallback(X.updates(spark, sf_dir)).select("panel_id", "as_of", "model_id", "source", F.round("final_value", 4).alias("final_value"))


@CORE.add("a14_best_by_criterion", W("upf", "SELECT panel_id, target_quarter, k, round(bic, 4) AS bic FROM (SELECT panel_id, target_quarter, right(split_part(model_id, '_', 2), 1)::INTEGER AS k, value AS bic, as_of FROM upf WHERE value IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY panel_id, target_quarter ORDER BY bic, k) = 1"))
def a14(spark, sf_dir):
    fits = X.updates(spark, sf_dir).select("panel_id", "target_quarter", F.regexp_extract("model_id", r"r(\d)", 1).cast("int").alias("k"), F.col("value").alias("bic"))
    return C.best_by_criterion(fits, keys=("panel_id", "target_quarter")).select("panel_id", "target_quarter", "k", F.round("bic", 4).alias("bic"))


@CORE.add("f14_mixture_grid", W("obs", "SELECT DISTINCT panel_id, 'DFM_r' || r || '_p' || p AS model_id, r, p FROM obs, (SELECT unnest([2, 3, 4, 5])::INTEGER AS r), (SELECT unnest([1, 2, 3])::INTEGER AS p)"))
def f14(spark, sf_dir):
    panels = X.observations(spark, sf_dir).select("panel_id").distinct()
    return panels.crossJoin(F.broadcast(C.mixture_grid(spark, [2, 3, 4, 5], [1, 2, 3])))
