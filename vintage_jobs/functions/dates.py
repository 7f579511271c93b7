"""Calendar expressions: reference dates, publication lags, as-of rules and release calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter").cast("date")


def reference_time(period: Column, freq: Column, ref_point: Column) -> Column:
    """The instant an observation period refers to. A period's end is one microsecond before the next begins."""
    micro = F.make_dt_interval(secs=F.lit(0.000001).cast("decimal(18,6)"))
    start = F.when(freq == "Q", quarter_start(period)).otherwise(month_start(period))
    after = F.add_months(start, F.when(freq == "Q", 3).otherwise(1))
    own = (freq == "timestamp") | (ref_point == "timestamp")
    return F.when(own, ntz(period)).when(ref_point == "period_start", ntz(start)).otherwise(ntz(after) - micro)


def available_at(reference: Column, unit: Column, value: Column) -> Column:
    """Reference instant plus a lag in days, weeks or months; month ends are clipped. Any other unit is an error."""
    days = F.make_dt_interval(days=F.when(unit == "weeks", value * 7).otherwise(value))
    known = F.when(unit.isin("days", "weeks"), reference + days).when(unit == "months", reference + F.make_ym_interval(F.lit(0), value))
    return F.when(unit.isin("days", "weeks", "months") | unit.isNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown lag unit: "), unit)).cast("timestamp_ntz"))


def asof_month(target: Column, rule: str) -> Column:
    """The month a forecast of ``target`` is made in: end (same), mid (one before) or early (two before)."""
    back = {"end": 0, "mid": 1, "early": 2}
    if rule not in back:
        raise ValueError(f"unknown as-of rule: {rule}")
    return F.add_months(month_start(target), -back[rule])


def quarter_month(as_of: Column, phase: Column | int) -> Column:
    """The next month, from the as-of month on, whose number has the target's remainder modulo three."""
    start = month_start(as_of)
    return F.add_months(start, F.pmod(F.lit(phase) - F.month(start), F.lit(3)))


def previous_quarter_month(month: Column) -> Column:
    return F.add_months(month, -3)


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day), F.lit("Q"), F.quarter(day))


def month_end_grid(start: Column, end: Column) -> Column:
    """Month ends within [start, end], as an array."""
    months = F.sequence(month_start(start), end, F.expr("interval 1 month"))
    return F.filter(F.transform(months, F.last_day), lambda d: (d >= start) & (d <= end))


def horizon_months(train_end: Column, target: Column) -> Column:
    """Months from the end of the sample to the target, at least one."""
    return F.greatest(F.lit(1), (F.year(target) - F.year(train_end)) * 12 + F.month(target) - F.month(train_end))


def explicit_dates(text: Column, start: Column, end: Column) -> Column:
    """Sorted distinct dates of a ``;``-separated text within [start, end]; parts that are no dates are skipped."""
    dates = F.transform(F.split(text, ";"), lambda p: F.try_to_date(F.trim(p), "yyyy-MM-dd"))
    return F.sort_array(F.array_distinct(F.filter(dates, lambda d: d.isNotNull() & (d >= start) & (d <= end))))


def clamped_day(month: Column, day: Column) -> Column:
    """The day of a month, or its last day where the month is shorter."""
    return F.date_add(month, F.least(day, F.day(F.last_day(month))) - 1)


def nth_weekday(month: Column, week: Column, weekday: Column) -> Column:
    """The week-th given weekday (0: Monday) of a month; the last one if there are fewer; null for week < 1."""
    first = F.date_add(month, F.pmod(weekday - F.weekday(month), F.lit(7)).cast("int"))
    day = F.date_add(first, ((week - 1) * 7).cast("int"))
    last = F.last_day(month)
    final = F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)).cast("int"))
    return F.when(week >= 1, F.when(day <= last, day).otherwise(final))
