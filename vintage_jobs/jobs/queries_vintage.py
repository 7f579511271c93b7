"""Registered queries: vintages, calendars and update schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintage_jobs.functions import dates as D
from vintage_jobs.jobs import fixtures as X
from vintage_jobs.jobs.fixtures import with_tables as W
from vintage_jobs.jobs.registry import CORE
from vintage_jobs.operators import schedule as S
from vintage_jobs.operators import vintage as V
from vintage_jobs.sources import panels as P


@CORE.add("f1_f2_availability", W("avail", "SELECT * FROM avail"))
def f12(spark, sf_dir):
    return V.with_availability(X.panel(spark, sf_dir), X.lags(spark, sf_dir))


@CORE.add("j4_lag_lookup", W("lagged", "SELECT DISTINCT panel_id, series_id, freq, ref_point, lag_unit, lag_value FROM lagged"))
def j4(spark, sf_dir):
    return V.with_lags(X.panel(spark, sf_dir), X.lags(spark, sf_dir)).drop("period", "value").distinct()


@CORE.add("f10_month_ends", W("asofs", "SELECT as_of FROM asofs"))
def f10(spark, sf_dir):
    return X.asofs(spark, sf_dir)


@CORE.add("j1_vintages", W("vint", "SELECT * FROM vint"))
def j1(spark, sf_dir):
    return V.vintages(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir))


@CORE.add("j1_published_by_day_end", W("avail asofs", "SELECT as_of, panel_id, count(*) AS n, max(period) AS newest FROM avail JOIN asofs ON available_at < (as_of + INTERVAL 1 DAY)::TIMESTAMP WHERE value IS NOT NULL GROUP BY ALL"))
def j1b(spark, sf_dir):
    seen = V.published(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir), inclusive_day=True)
    return seen.groupBy("as_of", "panel_id").agg(F.count("*").alias("n"), F.max("period").alias("newest"))


@CORE.add("j2_truncated_vintages", W("grid asofs", "SELECT as_of, panel_id, series_id, period, CASE WHEN period <= as_of THEN value END AS value FROM grid, asofs"))
def j2(spark, sf_dir):
    return V.truncated_vintages(X.panel(spark, sf_dir), X.asofs(spark, sf_dir))


@CORE.add("j3_month_lag_vintages", W("grid asofs mlags", "SELECT as_of, panel_id, series_id, period, CASE WHEN period <= (date_trunc('month', as_of) - coalesce(lag, 0) * INTERVAL 1 MONTH)::DATE THEN value END AS value FROM grid LEFT JOIN mlags USING (series_id) JOIN asofs ON period <= as_of"))
def j3(spark, sf_dir):
    return V.month_lag_vintages(X.panel(spark, sf_dir), X.month_lags(spark, sf_dir), X.asofs(spark, sf_dir))


@CORE.add("a10_manifest", W("vint", "SELECT as_of, panel_id, 'vintage_' || strftime(as_of, '%Y-%m-%d') AS file, count(DISTINCT period) AS n_rows, count(DISTINCT series_id) AS n_cols, round(1 - count(value) / (count(DISTINCT period) * count(DISTINCT series_id)), 8) AS na_share FROM vint GROUP BY as_of, panel_id"))
def a10(spark, sf_dir):
    return V.manifest(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir)).withColumn("na_share", F.round("na_share", 8))


@CORE.add("p5_training_samples", W("grid asofs", "SELECT as_of, panel_id, series_id, count(*) AS n_months, count(value) AS n FROM grid JOIN asofs ON period <= as_of WHERE period >= DATE '1995-06-01' GROUP BY ALL"))
def p5(spark, sf_dir):
    sample = V.training_sample(X.panel(spark, sf_dir), X.asofs(spark, sf_dir), "1995-06-01")
    return sample.groupBy("as_of", "panel_id", "series_id").agg(F.count("*").alias("n_months"), F.count("value").alias("n"))


@CORE.add("j6_target_quarter", W("spans asofs", "SELECT as_of, panel_id, coalesce(min(CASE WHEN q + INTERVAL 3 MONTH - INTERVAL 1 MICROSECOND + INTERVAL 45 DAY > as_of THEN q END), max(hi) + INTERVAL 3 MONTH)::DATE AS quarter FROM (SELECT panel_id, unnest(generate_series(date_trunc('quarter', lo), date_trunc('quarter', hi) + INTERVAL 24 MONTH, INTERVAL 3 MONTH)) AS q, date_trunc('quarter', hi) + INTERVAL 24 MONTH AS hi FROM spans), asofs GROUP BY as_of, panel_id"))
def j6(spark, sf_dir):
    return V.target_quarters(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir), P.TARGET)


PHASE = "ph AS (SELECT panel_id, arg_max(phase, (n, -first)) AS phase FROM (SELECT panel_id, month(period) % 3 AS phase, count(*) AS n, min(period) - DATE '1970-01-01' AS first FROM grid WHERE series_id = 'TOTAL' AND value IS NOT NULL GROUP BY ALL) GROUP BY panel_id)"


@CORE.add("a7_target_phase", W("grid", "SELECT * FROM ph", PHASE))
def a7(spark, sf_dir):
    return V.target_phase(X.panel(spark, sf_dir), P.TARGET).withColumn("phase", F.col("phase").cast("long"))


@CORE.add("p6_quarter_months", W("grid", "SELECT panel_id, series_id, period, CASE WHEN series_id <> 'NATION_0' OR month(period) % 3 = phase THEN value END AS value FROM grid LEFT JOIN ph USING (panel_id)", PHASE.replace("TOTAL", "NATION_0")))
def p6(spark, sf_dir):
    return V.quarter_months_only(X.panel(spark, sf_dir), "NATION_0")


@CORE.add("a4_standardised_vintages", W("vint", "SELECT as_of, panel_id, series_id, period, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 5) AS z FROM vint WINDOW w AS (PARTITION BY as_of, panel_id, series_id)"))
def a4(spark, sf_dir):
    parts = X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir)
    return V.standardised_from(V.vintages(*parts), V.vintage_moments(*parts)).select("as_of", "panel_id", "series_id", "period", F.round("z", 5).alias("z"))


@CORE.add("a4_vintage_moments", W("vint", "SELECT as_of, panel_id, series_id, count(value) AS n, round(avg(value) / pi(), 3) AS mean, round(stddev_pop(value) / pi(), 3) AS sd FROM vint GROUP BY ALL"))
def a4_moments(spark, sf_dir):
    found = V.vintage_moments(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir))
    return found.select("as_of", "panel_id", "series_id", F.col("n").cast("long").alias("n"), F.round(F.col("mean") / F.pi(), 3).alias("mean"), F.round(F.col("sd") / F.pi(), 3).alias("sd"))


@CORE.add("a16_last_known_target", W("vint", "SELECT as_of, panel_id, arg_max(value, period) AS fallback_value FROM vint WHERE series_id = 'TOTAL' AND value IS NOT NULL GROUP BY ALL"))
def a16(spark, sf_dir):
    from vintage_jobs.operators.combine import last_known_target

    return last_known_target(V.vintages(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.asofs(spark, sf_dir)), P.TARGET)


BUNDLE = "ev AS (SELECT available_at::DATE AS as_of, panel_id, list_sort(list(DISTINCT series_id)) AS released_series FROM avail WHERE available_at::DATE BETWEEN (SELECT s FROM span) AND (SELECT e FROM span) GROUP BY ALL)"


@CORE.add("a12_bundled_releases", W("avail span", "SELECT as_of, panel_id, array_to_string(released_series, ',') AS released_series FROM ev", BUNDLE))
def a12(spark, sf_dir):
    days = S.release_days(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.span(spark, sf_dir))
    return S.bundled_by_day(days).withColumn("released_series", F.array_join("released_series", ","))


@CORE.add("j13_with_empty_days", W("avail span", "SELECT d.as_of, p.panel_id, coalesce(len(released_series), 0)::BIGINT AS n_series FROM (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS as_of FROM span) d CROSS JOIN (SELECT DISTINCT panel_id FROM ev) p LEFT JOIN ev ON ev.as_of = d.as_of AND ev.panel_id = p.panel_id", BUNDLE))
def j13(spark, sf_dir):
    days = S.release_days(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.span(spark, sf_dir))
    return S.with_empty_days(S.bundled_by_day(days), X.span(spark, sf_dir)).select("as_of", "panel_id", F.size("released_series").cast("long").alias("n_series"))


@CORE.add("w11_order_violations", W("avail", "SELECT panel_id, seq, as_of, previous FROM (SELECT *, lag(as_of) OVER (PARTITION BY panel_id ORDER BY seq) AS previous FROM (SELECT panel_id, row_number() OVER (PARTITION BY panel_id ORDER BY period, series_id) AS seq, available_at::DATE AS as_of FROM avail)) WHERE previous >= as_of"))
def w11(spark, sf_dir):
    rows = V.with_availability(X.panel(spark, sf_dir), X.lags(spark, sf_dir))
    seq = F.row_number().over(Window.partitionBy("panel_id").orderBy("period", "series_id"))
    events = rows.select("panel_id", seq.cast("long").alias("seq"), F.col("available_at").cast("date").alias("as_of"))
    return S.order_violations(events).select("panel_id", "seq", "as_of", "previous")


def calendar_rules(spark, sf_dir):
    k = F.col("n_nationkey")
    return P.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("series_id"),
        F.when(k % 4 == 0, F.concat(F.lit("1996-03-05; bad;2050-01-01;1996-02-30;"), F.lit("1996-07-0"), (k % 9 + 1).cast("string"), F.lit(";1996-03-05"))).alias("release_dates"),
        F.when(k % 4 == 1, k + 7).alias("release_day_in_month"),
        F.when(k % 4 >= 2, k % 6).alias("release_week_in_month"),
        F.when(k % 4 >= 2, k % 7).alias("release_weekday"),
    )


CAL = "mo AS (SELECT unnest(generate_series(s, e, INTERVAL 1 MONTH))::DATE AS m FROM span)"


RULES_BY_DAY = f"""{CAL}, wk AS (SELECT n_name, n_nationkey % 6 AS week, m, (m + ((n_nationkey % 7 - (isodow(m) - 1) + 7) % 7)::INTEGER)::DATE AS first FROM nation, mo WHERE n_nationkey % 4 >= 2),
al AS (SELECT n_name AS series_id, DATE '1996-03-05' AS day FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_name, make_date(1996, 7, n_nationkey % 9 + 1) FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT n_name, (m + (least(n_nationkey + 7, day(last_day(m))) - 1)::INTEGER)::DATE FROM nation, mo WHERE n_nationkey % 4 = 1
UNION ALL SELECT n_name, CASE WHEN month(first + ((week - 1) * 7)::INTEGER) = month(m) THEN first + ((week - 1) * 7)::INTEGER WHEN month(first + 28) = month(m) THEN first + 28 ELSE first + 21 END::DATE FROM wk WHERE week >= 1)"""


@CORE.add("f11_f13_release_calendar", W("span", "SELECT series_id, day FROM al WHERE day BETWEEN (SELECT s FROM span) AND (SELECT e FROM span)", RULES_BY_DAY))
def f11(spark, sf_dir):
    return S.calendar_releases(calendar_rules(spark, sf_dir), X.span(spark, sf_dir))


def shown(events):
    return events.withColumn("released_series", F.array_join("released_series", ","))


@CORE.add("a12_unbundled_releases", W("avail span", "SELECT available_at::DATE AS as_of, panel_id, series_id AS released_series FROM avail WHERE available_at::DATE BETWEEN (SELECT s FROM span) AND (SELECT e FROM span)"))
def a12_single(spark, sf_dir):
    days = S.release_days(X.panel(spark, sf_dir), X.lags(spark, sf_dir), X.span(spark, sf_dir))
    return shown(S.update_events(days, bundle=False))


OF_PANELS = "SELECT day AS as_of, panel_id, series_id FROM al JOIN (SELECT DISTINCT panel_id, series_id FROM grid) USING (series_id) WHERE day BETWEEN (SELECT s FROM span) AND (SELECT e FROM span)"


@CORE.add("a12_calendar_events", W("grid span", f"SELECT as_of, panel_id, string_agg(DISTINCT series_id, ',' ORDER BY series_id) AS released_series FROM ({OF_PANELS}) GROUP BY ALL", RULES_BY_DAY))
def a12_calendar(spark, sf_dir):
    """Events of each panel by the calendar rules of its series: explicit dates, a day or an n-th weekday of the month."""
    return shown(S.update_events(S.calendar_days(X.panel(spark, sf_dir), calendar_rules(spark, sf_dir), X.span(spark, sf_dir))))


@CORE.add("a12_calendar_single_events", W("grid span", f"SELECT as_of, panel_id, series_id AS released_series FROM ({OF_PANELS})", RULES_BY_DAY))
def a12_calendar_single(spark, sf_dir):
    return shown(S.update_events(S.calendar_days(X.panel(spark, sf_dir), calendar_rules(spark, sf_dir), X.span(spark, sf_dir)), bundle=False))


@CORE.add("f3_f5_months", "SELECT DISTINCT o_orderdate::DATE AS day, date_trunc('month', o_orderdate)::DATE AS end_month, (date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE AS mid_month, (date_trunc('month', o_orderdate) - INTERVAL 2 MONTH)::DATE AS early_month, (date_trunc('month', o_orderdate) + ((2 - month(o_orderdate) % 3 + 3) % 3) * INTERVAL 1 MONTH)::DATE AS q_now, (date_trunc('month', o_orderdate) + ((2 - month(o_orderdate) % 3 + 3) % 3 - 3) * INTERVAL 1 MONTH)::DATE AS q_back FROM orders")
def f3(spark, sf_dir):
    day = F.col("day")
    days = P.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    q = D.quarter_month(day, 2)
    return days.select("day", *(D.asof_month(day, r).alias(f"{r}_month") for r in ("end", "mid", "early")), q.alias("q_now"), D.previous_quarter_month(q).alias("q_back"))
