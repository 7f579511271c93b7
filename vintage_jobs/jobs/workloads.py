"""The three jobs the operators add up to: a model-ready panel, stored vintages, and a backtest with its evaluation.

Each step starts from a stored panel of one row a cell; only the small fits of ``fanout`` leave the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage_jobs.functions.dates import month_start, quarter_month
from vintage_jobs.functions.scalars import finite
from vintage_jobs.jobs import fanout as J
from vintage_jobs.operators import combine as C
from vintage_jobs.operators import evaluate as E
from vintage_jobs.operators import features as T
from vintage_jobs.operators import transform as R
from vintage_jobs.operators import vintage as V
from vintage_jobs.sources import panels as P
from vintage_jobs.sources import vintage_store as K
from vintage_jobs.sources.store import stored


def model_ready_panel(panel: DataFrame, target: str, adjust: list[str], change: list[str], rate: list[str], alpha: float = 0.05, point_in_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stationary, standardised panel (z beside value), and the decisions it rests on.

    Seasonal adjustment of the series in ``adjust``; a unit-root test and a rule for each; the transformed panel without
    its first month and without empty months; a second test and a second difference of what is still not stationary,
    again without the first month; z-scores. With ``point_in_time`` the adjustment, tests, rules, second tests and z-scores
    of a period rest on the values up to it, and the decisions have a row a period; a series without a rule yet (it needs 25
    values) is under that of a failed test.
    """
    if point_in_time:
        return _ready_in_time(panel, target, adjust, change, rate, alpha)
    own = stored(J.seasonally_adjusted(panel.where(F.col("series_id") != target), adjust).unionByName(panel.where(F.col("series_id") == target)), "adjusted")
    tests = J.unit_root_tests(own.where(F.col("series_id") != target), alpha).select("panel_id", "series_id", "p_value")
    rules = stored(R.decisions(tests, target, change, rate, alpha), "decisions")
    changed = R.without_empty_periods(R.without_first_periods(R.transformed(own, rules, target)))
    changed = stored(changed, "transformed")
    again = stored(J.unit_root_tests(changed.where(F.col("series_id") != target), alpha).select("panel_id", "series_id", F.col("p_value").alias("second_p_value"), "stationary"), "second-tests")
    differenced = R.without_first_periods(R.second_differences(changed, again.where(~F.col("stationary")), target))
    decided = rules.select("panel_id", "series_id", "rule", "p_value").join(again.select("panel_id", "series_id", "second_p_value", F.col("stationary").alias("stationary_then")), ["panel_id", "series_id"], "left")
    return R.z_scores(differenced), decided


def _ready_in_time(panel: DataFrame, target: str, adjust: list[str], change: list[str], rate: list[str], alpha: float) -> tuple[DataFrame, DataFrame]:
    keys = ["panel_id", "series_id", "period"]
    own = stored(J.seasonally_adjusted(panel.where(F.col("series_id") != target), adjust, point_in_time=True).unionByName(panel.where(F.col("series_id") == target)), "adjusted")
    rules = stored(R.decisions(J.unit_root_tests_in_time(own.where(F.col("series_id") != target), alpha).select(*keys, "p_value"), target, change, rate, alpha), "decisions")
    changed = stored(R.without_empty_periods(R.without_first_periods(R.transformed(own, rules, target))), "transformed")
    again = stored(J.unit_root_tests_in_time(changed.where(F.col("series_id") != target), alpha).select(*keys, F.col("p_value").alias("second_p_value"), "stationary"), "second-tests")
    differenced = R.without_first_periods(R.second_differences(changed, again.where(~F.col("stationary")), target))
    decided = rules.select(*keys, "rule", "p_value").join(again.select(*keys, "second_p_value", F.col("stationary").alias("stationary_then")), keys, "left")
    return R.z_scores(differenced, point_in_time=True), decided


def stored_vintages(panel: DataFrame, lags: DataFrame, as_ofs: DataFrame, path: str) -> DataFrame:
    """Writes the panel's values with the time each was current, once, and returns the manifest of the vintages that a
    reader finds there at the as-ofs."""
    K.write_store(V.with_availability(panel, lags), path)
    return K.manifest_from(K.read_store(panel.sparkSession, path), as_ofs)


def exported_vintages(panel: DataFrame, lags: DataFrame, as_ofs: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Writes the vintage of each as-of to a folder of its own, a dense copy an as-of for others to read, and returns their
    manifest, read from what was written."""
    P.write_vintages(V.vintages(panel, lags, as_ofs), path, fmt)
    spark = panel.sparkSession
    schema = "panel_id string, series_id string, period date, value double, as_of date"
    found = spark.read.schema(schema).option("header", True).format(fmt).load(path)
    return found.groupBy("as_of", "panel_id").agg(
        F.count_distinct("period").alias("n_rows"),
        F.count_distinct("series_id").alias("n_cols"),
        F.count("*").alias("n_cells"),
        (1 - F.count("value") / F.count("*")).alias("na_share"),
    )


def mixture_over_time(fits: DataFrame, targets: DataFrame, as_ofs: DataFrame, point_in_time: bool = False, every: int = 3) -> DataFrame:
    """Now- and backcast of each vintage: the mean of its clipped usable specifications, beside the truth.

    ``fits`` has y_now, y_back, ok by (panel_id, as_of, model_id). Clips go to the extremes of all targets, or with
    ``point_in_time`` of those up to the as-of. A vintage that holds neither month gives no row. A fit that did not
    converge still counts, as its forecast is usable. The target has a value ``every`` so many months: three or one.
    """
    bounds = E.bounds_in_time(targets, as_ofs) if point_in_time else E.bounds(targets, "minmax")
    now = quarter_month(F.col("as_of"), 0) if every == 3 else month_start(F.col("as_of"))
    back = F.add_months(now, -every)

    def records(value: str, quarter) -> DataFrame:
        rows = fits.where(F.col(value).isNotNull() | ~F.col("ok"))
        return rows.select("panel_id", "as_of", quarter.alias("target_quarter"), "model_id", F.col(value).alias("value"), "ok", F.lit(True).alias("converged"), "error")

    both = records("y_now", now).unionByName(records("y_back", back))
    mixed = C.with_truth(C.mixture(both, bounds), targets).where("n_used > 0")
    is_now = F.col("target_quarter") == now
    pick = lambda c, when: F.max(F.when(when, F.col(c)))
    return mixed.groupBy("panel_id", "as_of").agg(
        F.max(now).alias("q_now"),
        F.max(back).alias("q_back"),
        pick("mixture", is_now).alias("mix_nowcast"),
        pick("mixture", ~is_now).alias("mix_backcast"),
        pick("true_now", is_now).alias("true_now"),
        pick("true_now", ~is_now).alias("true_back"),
        F.coalesce(pick("n_used", is_now), F.lit(0)).alias("n_components_now"),
        F.coalesce(pick("n_used", ~is_now), F.lit(0)).alias("n_components_back"),
    )


def model_forecasts(trees: DataFrame, mixed: DataFrame) -> DataFrame:
    """The forecasts of trees, autoregression and mixture (its latest nowcast) for each target of the trees, in long form."""
    targets = trees.select("panel_id", "target_period", F.col("y_true").alias("y"))
    now = mixed.select("panel_id", "as_of", F.col("q_now").alias("target_quarter"), F.col("mix_nowcast").alias("mixture"))
    mixture = C.aligned(now, targets).select("panel_id", F.lit("dfm").alias("model_id"), "target_period", F.col("y").alias("y_true"), "y_pred")
    own = [trees.select("panel_id", F.lit(m).alias("model_id"), "target_period", "y_true", F.col(c).alias("y_pred")) for m, c in (("tree", "y_pred"), ("ar1", "y_pred_ar1"))]
    return reduce(DataFrame.unionByName, [*own, mixture])


def evaluation(forecasts: DataFrame, model_a: str, model_b: str, min_train: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choices between two models by expected loss, metrics of all models and of the choice, and counts of the choices.

    Without ``min_train`` a panel's selection begins after its own ``selection_minimum``, from the dates on which both
    models and the truth are known.
    """
    losses = E.loss_differences(forecasts, model_a, model_b)
    chosen = stored(J.selected_forecasts(losses, min_train=E.selection_minimum(losses) if min_train is None else min_train), "selected")
    selected = chosen.where(finite(F.col("y_true"))).select("panel_id", F.lit("selected").alias("model_id"), "target_period", "y_true", F.col("y_selected").alias("y_pred"))
    every = E.running_rmse(forecasts.unionByName(selected))
    last = every.groupBy("panel_id", "model_id").agg(F.max_by("rmse", "target_period").alias("last_rmse"))
    return chosen, E.metrics(forecasts.unionByName(selected)).join(last, ["panel_id", "model_id"]), E.choice_counts(chosen)


def tree_rows(targets: DataFrame, predictors: DataFrame, lags: DataFrame, rule: str = "end") -> DataFrame:
    return T.supervised_rows(T.lagged_features(targets, predictors, lags, rule=rule), targets)
