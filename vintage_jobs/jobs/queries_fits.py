"""Registered queries: fits fanned out over groups (checked against independent computations in tests)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vintage_jobs.jobs import fanout as J
from vintage_jobs.jobs import fixtures as X
from vintage_jobs.jobs.queries_backtest import quarter_targets
from vintage_jobs.jobs import workloads as W
from vintage_jobs.jobs.fixtures import with_tables
from vintage_jobs.jobs.queries_panel import CHANGE, RATE
from vintage_jobs.jobs.registry import CORE
from vintage_jobs.operators import combine as C
from vintage_jobs.operators import evaluate as E
from vintage_jobs.operators import vintage as V
from vintage_jobs.sources import panels as P
from vintage_jobs.sources import vintage_store as K
from vintage_jobs.sources.store import shared_dir, stored


@CORE.add("x1_unit_root_tests")
def x1(spark, sf_dir):
    return J.unit_root_tests(X.observations(spark, sf_dir))


@CORE.add("x2_seasonally_adjusted")
def x2(spark, sf_dir):
    return J.seasonally_adjusted(X.panel(spark, sf_dir).where(F.col("series_id") != P.TARGET))


@CORE.add("x2_adjusted_in_time")
def x2_in_time(spark, sf_dir):
    """Each value less the seasonal part that was known with it."""
    return J.seasonally_adjusted(X.panel(spark, sf_dir).where(F.col("series_id") != P.TARGET), point_in_time=True)


@CORE.add("x3_selected_forecasts")
def x3(spark, sf_dir):
    return J.selected_forecasts(E.loss_differences(X.forecasts(spark, sf_dir), "ar1", "mean"))


@CORE.add("x1_unit_root_tests_in_time")
def x1_in_time(spark, sf_dir):
    return J.unit_root_tests_in_time(X.observations(spark, sf_dir))


def monthly_trees(spark, sf_dir):
    """Trees for the monthly total of each panel: it has targets enough for the operator's own settings."""
    predictors = X.panel(spark, sf_dir).where(F.col("series_id") != P.TARGET)
    return J.boosted_backtest(W.tree_rows(X.targets(spark, sf_dir), predictors, X.month_lags(spark, sf_dir)))


def quarterly_trees(spark, sf_dir):
    """Trees for the quarterly total. A panel has under 30 quarters, so a forecast needs 12 and leaves are smaller."""
    targets, predictors = quarter_targets(spark, sf_dir)
    return J.boosted_backtest(W.tree_rows(targets, predictors, X.month_lags(spark, sf_dir)), min_train=12, leaf=3, split=6)


@CORE.add("x4_boosted_backtest")
def x4(spark, sf_dir):
    return quarterly_trees(spark, sf_dir)


@CORE.add("x4_boosted_monthly")
def x4_monthly(spark, sf_dir):
    return monthly_trees(spark, sf_dir)


@CORE.add("x5_factor_mixture")
def x5(spark, sf_dir):
    panel = X.panel(spark, sf_dir)
    as_ofs = V.panel_asofs(panel, 60)
    made = J.factor_mixture(panel, X.month_lags(spark, sf_dir), as_ofs, C.mixture_grid(spark, [2, 3, 4, 5], [1, 2, 3]), P.TARGET)
    return made.select("panel_id", "as_of", "model_id", "y_now", "y_back", "loglik", "ok", "converged", "error")


@CORE.add("wl3_mixture_over_time")
def wl3_mixture(spark, sf_dir):
    as_ofs = V.panel_asofs(X.panel(spark, sf_dir), 60)
    return W.mixture_over_time(stored(x5(spark, sf_dir), "factor-fits"), quarter_targets(spark, sf_dir)[0], as_ofs.select("as_of").distinct())


def monthly_mixture(spark, sf_dir):
    """Mixtures of two factor models for the monthly total, from month 26 on, so that selection has losses enough."""
    targets = X.targets(spark, sf_dir)
    total = targets.select("panel_id", F.lit(P.TARGET).alias("series_id"), F.col("target_period").alias("period"), F.col("y").alias("value"))
    panel = stored(X.panel(spark, sf_dir).where(F.col("series_id") != P.TARGET).unionByName(total), "monthly-panel")
    as_ofs = V.panel_asofs(panel, 26)
    made = J.factor_mixture(panel, X.month_lags(spark, sf_dir), as_ofs, C.mixture_grid(spark, [1, 2], [1]), P.TARGET, add_mu=True, every=1)
    return W.mixture_over_time(stored(made, "factor-fits"), targets, as_ofs.select("as_of").distinct(), every=1)


@CORE.add("wl3_evaluation")
def wl3_evaluation(spark, sf_dir):
    """Metrics of all models and of the selection between trees and mixture, on quarterly and on monthly targets, and
    between the baselines. A panel has fewer quarters than selection needs, so there it selects on the monthly ones."""
    quarterly = W.model_forecasts(stored(quarterly_trees(spark, sf_dir), "trees"), wl3_mixture(spark, sf_dir))
    monthly = W.model_forecasts(stored(monthly_trees(spark, sf_dir), "trees"), monthly_mixture(spark, sf_dir))
    grids = [("quarter", quarterly, "tree", "dfm"), ("month", monthly, "tree", "dfm"), ("baseline", X.forecasts(spark, sf_dir), "ar1", "mean")]
    parts = [W.evaluation(stored(rows, "forecasts"), a, b)[1].withColumn("grid", F.lit(grid)) for grid, rows, a, b in grids]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@CORE.add("wl1_model_ready_panel")
def wl1_whole(spark, sf_dir):
    return W.model_ready_panel(X.panel(spark, sf_dir), P.TARGET, ["NATION_0", "NATION_2", "NATION_4", "NATION_12"], CHANGE, RATE)[0]


@CORE.add("wl1_ready_in_time")
def wl1_in_time(spark, sf_dir):
    """The model-ready panel whose adjustment, tests, rules and z-scores of a month rest on the months up to it."""
    return W.model_ready_panel(X.panel(spark, sf_dir), P.TARGET, ["NATION_0", "NATION_2", "NATION_4", "NATION_12"], CHANGE, RATE, point_in_time=True)[0]


def new_folder(spark):
    return f"{shared_dir(spark)}/vintages-{uuid.uuid4().hex}"


MANIFEST = "SELECT as_of, panel_id, count(DISTINCT period) AS n_rows, count(DISTINCT series_id) AS n_cols, count(*) AS n_cells, round(1 - count(value) / count(*), 8) AS na_share FROM vint GROUP BY as_of, panel_id"


@CORE.add("wl2_written_vintages", with_tables("vint", MANIFEST))
def wl2(spark, sf_dir):
    """Values stored with their time, and the manifest of the vintages read from there."""
    made = W.stored_vintages(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir), new_folder(spark))
    return made.withColumn("na_share", F.round("na_share", 8))


@CORE.add("wl2_exported_vintages", with_tables("vint", MANIFEST))
def wl2_exported(spark, sf_dir):
    """A dense copy an as-of, for readers of files."""
    made = W.exported_vintages(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir), new_folder(spark))
    return made.withColumn("na_share", F.round("na_share", 8))


def vintage_store(spark, sf_dir):
    path = new_folder(spark)
    K.write_store(V.with_availability(X.panel(spark, sf_dir), X.lags(spark, sf_dir)), path)
    return K.read_store(spark, path)


@CORE.add("s6_vintages_from_store", with_tables("vint", "SELECT * FROM vint WHERE value IS NOT NULL"))
def s6_many(spark, sf_dir):
    return K.vintages_from(vintage_store(spark, sf_dir), X.asofs(spark, sf_dir))


@CORE.add("s6_vintage_at", with_tables("avail", "SELECT panel_id, series_id, period, value FROM avail WHERE available_at < TIMESTAMP '1998-07-16' AND value IS NOT NULL"))
def s6_at(spark, sf_dir):
    """All that was out by the end of 15 July 1998: folders of later months are not opened."""
    return K.vintage_at(vintage_store(spark, sf_dir), "1998-07-15", inclusive_day=True)


@CORE.add("s6_dense_vintage_at", with_tables("avail", "SELECT panel_id, series_id, period, CASE WHEN available_at <= TIMESTAMP '1998-07-15' THEN value END AS value FROM avail"))
def s6_dense(spark, sf_dir):
    return K.vintage_at(vintage_store(spark, sf_dir), "1998-07-15", dense=True)


#: Preliminary values come out by each series' lag and their revisions 40 days later; every fifth month is not revised.
REVISED = "rev AS (SELECT panel_id, series_id, period, value - 100 AS value, available_at FROM avail WHERE value IS NOT NULL UNION ALL SELECT panel_id, series_id, period, value, available_at + INTERVAL 40 DAY FROM avail WHERE value IS NOT NULL AND month(period) % 5 <> 0)"


@CORE.add("s6_revised_vintages", with_tables("avail asofs", "SELECT as_of, panel_id, series_id, period, value FROM (SELECT as_of, r.*, row_number() OVER (PARTITION BY as_of, panel_id, series_id, period ORDER BY available_at DESC) AS k FROM rev r JOIN asofs ON available_at <= as_of::TIMESTAMP) WHERE k = 1", REVISED))
def s6_revised(spark, sf_dir):
    """Vintages of a panel whose values are revised once: an interval ends where its revision comes out."""
    out = V.with_availability(X.panel(spark, sf_dir), X.lags(spark, sf_dir)).where("value IS NOT NULL")
    later = out.where(F.month("period") % 5 != 0).withColumn("available_at", F.col("available_at") + F.expr("INTERVAL 40 DAY"))
    path = new_folder(spark)
    K.write_store(out.withColumn("value", F.col("value") - 100).unionByName(later), path)
    return K.vintages_from(K.read_store(spark, path), X.asofs(spark, sf_dir))


@CORE.add("x6_factor_backtest")
def x6(spark, sf_dir):
    return C.best_by_criterion(J.factor_backtest(X.panel(spark, sf_dir), P.TARGET, min_months=60))
