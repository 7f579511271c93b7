"""Release calendars and update schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.functions import dates as D
from vintage_jobs.operators.vintage import with_availability


def release_days(panel: DataFrame, lags: DataFrame, span: DataFrame) -> DataFrame:
    """as_of (day), panel_id, series_id: days of the span (start, end) on which a series of a panel is published, by lag, once for each period."""
    day = F.col("available_at").cast("date")
    days = with_availability(panel, lags).select(day.alias("as_of"), "panel_id", "series_id")
    return days.join(F.broadcast(span), F.col("as_of").between(F.col("start"), F.col("end"))).drop("start", "end")


def bundled_by_day(days: DataFrame) -> DataFrame:
    """One event a day and panel with the sorted distinct series."""
    return days.groupBy("as_of", "panel_id").agg(F.sort_array(F.collect_set("series_id")).alias("released_series"))


def with_empty_days(events: DataFrame, span: DataFrame) -> DataFrame:
    """Adds the calendar days of the span without an event, with no series."""
    days = events.select("panel_id").distinct().crossJoin(F.broadcast(span)).select("panel_id", F.explode(F.sequence("start", "end")).alias("as_of"))
    empty = days.join(events, ["panel_id", "as_of"], "left_anti").withColumn("released_series", F.array().cast("array<string>"))
    return events.unionByName(empty)


def calendar_releases(rules: DataFrame, span: DataFrame) -> DataFrame:
    """series_id, day from explicit dates, else a fixed day, else an n-th weekday of each month, within the span (start, end)."""
    s, e = F.col("start"), F.col("end")
    months = F.sequence(D.month_start(s), D.month_start(e), F.expr("interval 1 month"))
    fixed = F.transform(months, lambda m: D.clamped_day(m, F.col("release_day_in_month")))
    nth = F.transform(months, lambda m: D.nth_weekday(m, F.col("release_week_in_month"), F.col("release_weekday")))
    chosen = F.when(F.col("release_dates").isNotNull(), D.explicit_dates(F.col("release_dates"), s, e)).when(F.col("release_day_in_month").isNotNull(), fixed).when(F.col("release_week_in_month").isNotNull() & F.col("release_weekday").isNotNull(), nth)
    return rules.crossJoin(F.broadcast(span)).select("series_id", "start", "end", F.explode(chosen).alias("day")).where(F.col("day").between(s, e)).drop("start", "end")


def calendar_days(panel: DataFrame, rules: DataFrame, span: DataFrame) -> DataFrame:
    """as_of (day), panel_id, series_id: the days of the span on which a series of a panel is due by its calendar rule."""
    series = panel.select("panel_id", "series_id").distinct()
    return series.join(calendar_releases(rules, span), "series_id").select(F.col("day").alias("as_of"), "panel_id", "series_id")


def update_events(days: DataFrame, bundle: bool = True) -> DataFrame:
    """as_of, panel_id, released_series: what a backtest is run for, from release days by lag or by calendar.

    One event a day and panel, or without ``bundle`` one a release.
    """
    return bundled_by_day(days) if bundle else days.select("as_of", "panel_id", F.array("series_id").alias("released_series"))


def order_violations(schedule: DataFrame) -> DataFrame:
    """Events that are not later than the one before them in their panel; a valid schedule has none."""
    before = F.lag("as_of").over(Window.partitionBy("panel_id").orderBy("seq"))
    return schedule.withColumn("previous", before).where(F.col("previous") >= F.col("as_of"))
