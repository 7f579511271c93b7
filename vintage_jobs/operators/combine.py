"""Combining forecasts: mixtures, fallbacks, information criteria and alignment.

Model forecasts are rows (panel_id, as_of, target_quarter, model_id, value, ok, converged, error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage_jobs.functions.dates import previous_quarter_month
from vintage_jobs.functions.scalars import clipped, failed_fit, finite

UPDATE = ["panel_id", "as_of", "target_quarter"]


def with_failed(forecasts: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Adds ``failed``. A null forecast of an ok fit counts as failed, unless ``strict_reference``."""
    bad = failed_fit(F.col("ok"), F.col("converged"), F.col("error"))
    return forecasts.withColumn("failed", bad if strict_reference else bad | F.col("value").isNull())


def mixture(forecasts: DataFrame, bounds: DataFrame, fallback: DataFrame | None = None, drop_failed: bool = True, strict_reference: bool = False) -> DataFrame:
    """Mean of the usable, clipped forecasts of each update with counts, the models used and all forecasts by model.

    ``bounds`` has lo, hi by panel_id (or by panel_id and as_of), ``fallback`` a fallback_value by update; without a usable forecast and without
    fallback the value is null here (``checked`` makes that an error).
    """
    own = with_failed(forecasts, strict_reference).join(bounds, [c for c in ("panel_id", "as_of") if c in bounds.columns], "left")
    usable = ~F.col("failed") | (F.lit(not drop_failed) & F.col("value").isNotNull())
    clip = clipped(F.col("value"), F.col("lo"), F.col("hi"))
    own = own.withColumns({"usable": usable, "use": F.when(usable, clip), "trimmed": usable & ~F.col("value").eqNullSafe(clip)})
    if strict_reference:
        own = own.withColumn("trimmed", F.col("trimmed") | (usable & F.col("value").isNull()))
    shown = F.when(F.col("failed"), F.col("value")).otherwise(F.col("use"))
    mixed = own.groupBy(*UPDATE).agg(
        F.avg("use").alias("mean"),
        F.sort_array(F.collect_list(F.when(F.col("usable"), F.col("model_id")))).alias("models_used"),
        F.count_if("usable").alias("n_used"),
        F.count_if("failed").alias("n_failed"),
        F.count_if("trimmed").alias("n_trimmed"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model_id", shown)))).alias("by_model"),
    )
    if fallback is not None:
        mixed = mixed.join(fallback, UPDATE, "left")
    else:
        mixed = mixed.withColumn("fallback_value", F.lit(None).cast("double"))
    return mixed.withColumn("mixture", F.when(F.col("n_used") > 0, F.col("mean")).otherwise(F.col("fallback_value"))).drop("mean", "fallback_value")


def checked(mixed: DataFrame) -> DataFrame:
    """Raises where an update has no mixture."""
    return mixed.withColumn("mixture", F.when(F.col("mixture").isNotNull(), F.col("mixture")).otherwise(F.raise_error(F.lit("all models failed and no fallback is given")).cast("double")))


def last_known_target(vintage: DataFrame, target: str) -> DataFrame:
    """as_of, panel_id, fallback_value: the latest visible target of each vintage (a random walk)."""
    seen = vintage.where((F.col("series_id") == target) & F.col("value").isNotNull())
    return seen.groupBy("as_of", "panel_id").agg(F.max_by("value", "period").alias("fallback_value"))


def with_previous(forecasts: DataFrame) -> DataFrame:
    """Adds previous_update (the update before, whatever its status) and previous_valid (the last good one)."""
    w = Window.partitionBy("panel_id", "model_id", "target_quarter").orderBy("as_of")
    good = F.when(~failed_fit(F.col("ok"), F.col("converged"), F.col("error")), F.struct(F.col("value").alias("v")))
    valid = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return forecasts.withColumns({"previous_update": F.lag("value").over(w), "previous_valid": valid["v"]})


def with_fallback(forecasts: DataFrame, prefer_previous_update: bool = True) -> DataFrame:
    """Adds final_value and source: ok, previous_update, previous_valid, or none (null value)."""
    own = with_previous(forecasts)
    ok = ~failed_fit(F.col("ok"), F.col("converged"), F.col("error")) & F.col("value").isNotNull()
    first = F.col("previous_update").isNotNull() & F.lit(prefer_previous_update)
    source = F.when(ok, "ok").when(first, "previous_update").when(F.col("previous_valid").isNotNull(), "previous_valid").otherwise("none")
    value = F.when(ok, F.col("value")).when(first, F.col("previous_update")).otherwise(F.col("previous_valid"))
    return own.withColumns({"source": source, "final_value": value}).drop("previous_update", "previous_valid")


def best_by_criterion(fits: DataFrame, criterion: str = "bic", keys: tuple[str, ...] = ("panel_id", "target_period"), order: str = "k") -> DataFrame:
    """The fit with the smallest finite criterion of each key; the smaller ``order`` wins ties."""
    return fits.where(finite(F.col(criterion))).groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(criterion, order)).alias("best")).select("best.*")


def mixture_grid(spark: SparkSession, r_values: list[int], p_values: list[int]) -> DataFrame:
    """model_id, r, p of every pair."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, r_values))).alias("r")).select("r", F.explode(F.array(*map(F.lit, p_values))).alias("p"))
    return grid.select(F.concat(F.lit("DFM_r"), "r", F.lit("_p"), "p").alias("model_id"), "r", "p")


def aligned(mixtures: DataFrame, targets: DataFrame, value: str = "mixture") -> DataFrame:
    """Each target with the non-null forecast of the latest as-of that was made for it."""
    latest = mixtures.where(F.col(value).isNotNull()).groupBy("panel_id", F.col("target_quarter").alias("target_period")).agg(F.max_by(value, "as_of").alias("y_pred"))
    return targets.join(latest, ["panel_id", "target_period"], "left")


def with_truth(mixtures: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds true_now and true_back: the target of the quarter and of the one before."""
    now = targets.select("panel_id", F.col("target_period").alias("target_quarter"), F.col("y").alias("true_now"))
    back = targets.select("panel_id", F.col("target_period").alias("back"), F.col("y").alias("true_back"))
    return mixtures.join(now, ["panel_id", "target_quarter"], "left").withColumn("back", previous_quarter_month(F.col("target_quarter"))).join(back, ["panel_id", "back"], "left")
