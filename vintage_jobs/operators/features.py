"""Lagged, delay-masked features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.functions.dates import asof_month


def split_target(panel: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The target's non-null periods (panel_id, target_period, y) and the predictors."""
    own = panel.where((F.col("series_id") == target) & F.col("value").isNotNull())
    return own.select("panel_id", F.col("period").alias("target_period"), F.col("value").alias("y")), panel.where(F.col("series_id") != target)


def target_lags(targets: DataFrame) -> DataFrame:
    """Adds ``y_lag1``, the previous observed target, and ``n_train``, the number of targets before this one."""
    w = Window.partitionBy("panel_id").orderBy("target_period")
    return targets.withColumns({"y_lag1": F.lag("y").over(w), "n_train": F.row_number().over(w) - 1})


def lagged_features(targets: DataFrame, predictors: DataFrame, lags: DataFrame, rule: str = "end", max_lag: int = 12, default_lag: int = 1) -> DataFrame:
    """panel_id, target_period, series_id, lag, x: the predictor ``lag`` months before the as-of month.

    Null where the lag is shorter than the series' publication delay in months. One equi join on the shifted month; the
    long form stays, so that no plan has a column for each of hundreds of features.
    """
    if max_lag < 0:
        raise ValueError("max_lag must not be negative")
    series = predictors.select("panel_id", "series_id").distinct().join(lags.select("series_id", F.col("lag").alias("delay")), "series_id", "left")
    wanted = targets.select("panel_id", "target_period").join(series, "panel_id").select("panel_id", "series_id", "target_period", F.coalesce("delay", F.lit(default_lag)).alias("delay"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    wanted = wanted.withColumn("period", F.add_months(asof_month(F.col("target_period"), rule), -F.col("lag")))
    found = wanted.join(predictors.select("panel_id", "series_id", "period", "value"), ["panel_id", "series_id", "period"], "left")
    return found.select("panel_id", "target_period", "series_id", "lag", F.when(F.col("lag") >= F.col("delay"), F.col("value")).alias("x"))


def supervised_rows(features: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target with its features as a sorted array, without targets whose features are all null."""
    rows = features.groupBy("panel_id", "target_period").agg(F.sort_array(F.collect_list(F.struct("series_id", "lag", "x"))).alias("f"), F.count("x").alias("n_known")).where("n_known > 0")
    return rows.join(target_lags(targets), ["panel_id", "target_period"]).select("panel_id", "target_period", "y", "y_lag1", "n_train", "n_known", F.col("f.x").alias("x"))


def chronological_split(rows: DataFrame, share: float, least: int = 5) -> DataFrame:
    """Adds ``is_validation``: the last max(1, floor(n share)) rows of a panel; an error if fewer than ``least`` are left."""
    w = Window.partitionBy("panel_id")
    n = F.count("*").over(w)
    held = F.greatest(F.lit(1), F.floor(n * share)).cast("int") if share > 0 else F.lit(0)
    left = n - held
    checked = F.when(left >= least, left).otherwise(F.raise_error(F.lit("too few rows are left to train on")).cast("long")) if share > 0 else n
    return rows.withColumn("is_validation", F.row_number().over(w.orderBy("target_period")) > checked)
