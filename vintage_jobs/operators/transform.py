"""Stationary and standardised series. All windows are keyed by panel and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.functions import scalars as S
from vintage_jobs.functions.dates import quarter_start

SERIES = ("panel_id", "series_id")


def by():
    return Window.partitionBy(*SERIES)


def in_time():
    return by().orderBy("period")


def profiles(panel: DataFrame) -> DataFrame:
    """n, n_distinct, any_negative, any_zero of each series."""
    v = F.col("value")
    return panel.groupBy(*SERIES).agg(F.count(v).alias("n"), F.count_distinct(v).alias("n_distinct"), F.coalesce(F.bool_or(v < 0), F.lit(False)).alias("any_negative"), F.coalesce(F.bool_or(v == 0), F.lit(False)).alias("any_zero"))


def differences(panel: DataFrame, name: str = "diff") -> DataFrame:
    """First differences by row of the grid; null beside a null."""
    return panel.withColumn(name, F.col("value") - F.lag("value").over(in_time()))


def log_differences(panel: DataFrame, least_logs: int = 10, many: int = 25, point_in_time: bool = False) -> DataFrame:
    """``change``: differences of safe logs, or plain ones where too few logs are usable while many values exist.

    What a series has is judged over all of it, or with ``point_in_time`` up to each period; both logs of a difference are
    then of the kind that is right at that period.
    """
    over = in_time().rowsBetween(Window.unboundedPreceding, 0) if point_in_time else by()
    v, before = F.col("value"), F.lag("value").over(in_time())
    negative, zero = (F.coalesce(F.bool_or(x).over(over), F.lit(False)) for x in (v < 0, v == 0))
    own = panel.withColumns({"negative": negative, "zero": zero, "before": before, "diff": v - before})
    log = lambda c: S.safe_log(c, F.col("negative"), F.col("zero"))
    own = own.withColumn("log_diff", log(v) - log(F.col("before"))).drop("negative", "zero", "before")
    fall_back = (F.count("log_diff").over(over) < least_logs) & (F.count(v).over(over) > many)
    return own.withColumn("change", F.when(fall_back, F.col("diff")).otherwise(F.col("log_diff")))


def quarterly_growth(panel: DataFrame, target: str) -> DataFrame:
    """panel_id, quarter, growth: log growth from the previous observed quarter, of the last value of each quarter."""
    seen = panel.where((F.col("series_id") == target) & F.col("value").isNotNull())
    last = seen.groupBy("panel_id", quarter_start(F.col("period")).alias("quarter")).agg(F.max_by("value", "period").alias("value"))
    log = F.when(F.col("value") > 0, F.ln("value"))
    return last.withColumn("log", log).select("panel_id", "quarter", (F.col("log") - F.lag("log").over(Window.partitionBy("panel_id").orderBy("quarter"))).alias("growth"))


def growth_on_dates(panel: DataFrame, target: str) -> DataFrame:
    """The target's observation dates with the growth of their quarter."""
    seen = panel.where((F.col("series_id") == target) & F.col("value").isNotNull()).withColumn("quarter", quarter_start(F.col("period")))
    return seen.join(quarterly_growth(panel, target), ["panel_id", "quarter"], "left").select("panel_id", "series_id", "period", F.col("growth").alias("value"))


def decisions(p_values: DataFrame, target: str, change: list[str], rate: list[str], alpha: float = 0.05) -> DataFrame:
    """The rule of each series from its p-value, with a fixed row for the target of each panel.

    Where the p-values have a period, the rules do too: what was decided then.
    """
    keys = [c for c in ("panel_id", "period") if c in p_values.columns]
    fixed = p_values.select(*keys).distinct().select(*keys, F.lit(target).alias("series_id"), F.lit(None).cast("double").alias("p_value"))
    own = p_values.where(F.col("series_id") != target).unionByName(fixed)
    s = F.col("series_id")
    is_in = lambda names: s.isin(*names) if names else F.lit(False)
    return own.withColumn("rule", S.transform_rule(s, F.col("p_value"), s == target, is_in(change), is_in(rate), alpha))


def transformed(panel: DataFrame, rules: DataFrame, target: str) -> DataFrame:
    """Each series under its rule; the target becomes quarterly log growth.

    Rules with a period hold from it to the next one of their series, and changes are then judged in time.
    """
    then = "period" in rules.columns
    others = log_differences(panel.where(F.col("series_id") != target), point_in_time=then)
    if then:
        others = others.join(rules.select(*SERIES, "period", "rule"), [*SERIES, "period"], "left").withColumn("rule", F.last("rule", ignorenulls=True).over(in_time()))
    else:
        others = others.join(rules.select(*SERIES, "rule"), list(SERIES))
    value = F.when(F.col("rule").isin(S.RULE_CHANGE, S.RULE_LEVEL), F.col("value")).when(F.col("rule") == S.RULE_DIFF, F.col("diff")).when(F.col("rule") == S.RULE_LOG, F.col("change"))
    on_grid = panel.where(F.col("series_id") == target).drop("value").join(growth_on_dates(panel, target), ["panel_id", "series_id", "period"], "left")
    return others.select(*SERIES, "period", value.alias("value")).unionByName(on_grid.select(*SERIES, "period", "value"))


def without_first_periods(panel: DataFrame, n: int = 1) -> DataFrame:
    """Drops the first n periods of each panel's grid: joined with the few edge dates, so the panel is not sorted."""
    starts = panel.select("panel_id", "period").distinct().withColumn("k", F.row_number().over(Window.partitionBy("panel_id").orderBy("period"))).where(F.col("k") == n).select("panel_id", F.col("period").alias("edge"))
    return panel.join(starts, "panel_id").where(F.col("period") > F.col("edge")).drop("edge")


def without_empty_periods(panel: DataFrame) -> DataFrame:
    """Drops the periods in which all series of the panel are null."""
    kept = panel.where(F.col("value").isNotNull()).select("panel_id", "period").distinct()
    return panel.join(kept, ["panel_id", "period"], "left_semi")


def second_differences(panel: DataFrame, still: DataFrame, target: str) -> DataFrame:
    """Differences once more the series in ``still``, never the target, over the rows that are left; where ``still`` has
    periods, only at these."""
    keys = [*SERIES, *(c for c in ("period",) if c in still.columns)]
    flagged = panel.join(still.select(*keys).distinct().withColumn("again", F.lit(True)), keys, "left")
    again = F.coalesce("again", F.lit(False)) & (F.col("series_id") != target)
    return flagged.select(*SERIES, "period", F.when(again, F.col("value") - F.lag("value").over(in_time())).otherwise(F.col("value")).alias("value"))


def z_scores(panel: DataFrame, point_in_time: bool = False) -> DataFrame:
    """``z``: value less the series' mean over its deviation (ddof 0); null where that is zero.

    Over the whole series, or with ``point_in_time`` over its values up to each period.
    """
    over = in_time().rowsBetween(Window.unboundedPreceding, 0) if point_in_time else by()
    sd = F.stddev_pop("value").over(over)
    return panel.withColumn("z", F.when(sd > 0, (F.col("value") - F.avg("value").over(over)) / sd))


def usable_series(panel: DataFrame) -> DataFrame:
    """Drops series without values or without a positive sample deviation."""
    good = panel.groupBy(*SERIES).agg(F.stddev_samp("value").alias("sd")).where(F.col("sd") > 0)
    return panel.join(good, list(SERIES), "left_semi")


def effective_size(panel: DataFrame, k_max: int = 6) -> DataFrame:
    """t_eff, n_eff and the largest factor count of each panel."""
    seen = F.col("value").isNotNull()
    sizes = panel.groupBy("panel_id").agg(F.count_distinct(F.when(seen, F.col("period"))).alias("t_eff"), F.count_distinct("series_id").alias("n_eff"))
    return sizes.withColumn("k", F.least(F.lit(k_max), F.col("t_eff"), F.col("n_eff")).cast("long"))
