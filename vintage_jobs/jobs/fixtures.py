"""Tables the registered queries share, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage_jobs.functions.dates import quarter_month
from vintage_jobs.operators import evaluate as E
from vintage_jobs.operators import vintage as V
from vintage_jobs.sources import lags as L
from vintage_jobs.sources import panels as P

#: The longest publication lag of ``lags`` in whole months: as-ofs and releases run so long after the last period.
LEAD = 3


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nation_panel(spark, sf_dir)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation panel with its quarterly target, on the monthly grid."""
    return P.monthly_grid(P.with_target(observations(spark, sf_dir)))


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.release_lags(L.nation_raw_lags(spark, sf_dir), "file_order")


def month_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, lag in months; the target has three, every fifth nation none."""
    nation = P.table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("series_id"), (F.col("n_nationkey") % 3).alias("lag"))
    return nation.unionByName(spark.range(1).select(F.lit(P.TARGET).alias("series_id"), F.lit(3).alias("lag")))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start, end: the days from the first period of the observations to the last release."""
    return V.panel_span(P.with_target(observations(spark, sf_dir)), LEAD)


def asofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.asof_grid(span(spark, sf_dir))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.monthly_target(observations(spark, sf_dir))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' forecasts of the monthly totals; the mean's are missing each July."""
    own = targets(spark, sf_dir)
    parts = []
    for name, made in (("ar1", E.expanding_ar1(own)), ("mean", E.expanding_mean(own))):
        pred = F.col("y_pred") if name == "ar1" else F.when(F.month("target_period") != 7, F.col("y_pred"))
        parts.append(made.select("panel_id", F.lit(name).alias("model_id"), "target_period", F.col("y").alias("y_true"), pred.alias("y_pred")))
    return reduce(DataFrame.unionByName, parts)


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast records of four models at each month end, some missing, failed or not converged."""
    k, m = F.col("k"), F.month("target_period")
    rows = targets(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return rows.select(
        "panel_id",
        F.last_day("target_period").alias("as_of"),
        quarter_month(F.col("target_period"), 0).alias("target_quarter"),
        F.concat(F.lit("DFM_r"), k, F.lit("_p1")).alias("model_id"),
        F.when((m + k) % 6 != 0, F.col("y") * (F.lit(0.8) + k * 0.1)).alias("value"),
        ((m + k) % 5 != 0).alias("ok"),
        F.when((m + k) % 7 == 0, F.lit(False)).alias("converged"),
        F.when((m + 2 * k) % 11 == 0, "singular").alias("error"),
    )


CTE = {
    "obs": "SELECT n_regionkey::VARCHAR AS panel_id, n_name AS series_id, date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "obst": "SELECT * FROM obs UNION ALL SELECT panel_id, 'TOTAL', (date_trunc('quarter', period) + INTERVAL 2 MONTH)::DATE AS p, sum(value::DECIMAL(20,2))::DOUBLE FROM obs GROUP BY panel_id, p",
    "spans": "SELECT panel_id, min(period) AS lo, max(period) AS hi FROM obst GROUP BY panel_id",
    "grid": "SELECT s.panel_id, s.series_id, g.period, o.value FROM (SELECT DISTINCT panel_id, series_id FROM obst) s JOIN (SELECT panel_id, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS period FROM spans) g USING (panel_id) LEFT JOIN obst o USING (panel_id, series_id, period)",
    "raw": "SELECT n_nationkey AS k, n_name AS series_id, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey <> 24 THEN n_nationkey % 4 * 7 END AS d, CASE WHEN n_nationkey % 3 <= 1 AND n_nationkey <> 24 THEN n_nationkey % 4 END AS w, CASE WHEN n_nationkey <> 24 THEN n_nationkey % 4 END AS m FROM nation",
    "lags": "SELECT series_id, CASE WHEN k = 2 THEN 'timestamp' WHEN k = 3 THEN 'Q' ELSE 'M' END AS freq, CASE WHEN k = 2 THEN 'timestamp' WHEN k = 1 THEN 'period_start' ELSE 'period_end' END AS ref_point, CASE WHEN d IS NOT NULL THEN 'days' WHEN w IS NOT NULL THEN 'weeks' ELSE 'months' END AS lag_unit, coalesce(d, w, m) AS lag_value FROM raw WHERE m IS NOT NULL UNION ALL SELECT 'TOTAL', 'Q', 'period_end', 'days', 45",
    "lagged": "SELECT g.*, coalesce(freq, 'M') AS freq, coalesce(ref_point, 'period_end') AS ref_point, coalesce(lag_unit, 'months') AS lag_unit, coalesce(lag_value, 0) AS lag_value FROM grid g LEFT JOIN lags USING (series_id)",
    "refd": "SELECT *, CASE WHEN freq = 'timestamp' OR ref_point = 'timestamp' THEN period::TIMESTAMP WHEN ref_point = 'period_start' THEN date_trunc(CASE WHEN freq = 'Q' THEN 'quarter' ELSE 'month' END, period)::TIMESTAMP ELSE date_trunc(CASE WHEN freq = 'Q' THEN 'quarter' ELSE 'month' END, period)::TIMESTAMP + (CASE WHEN freq = 'Q' THEN 3 ELSE 1 END) * INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND END AS ref FROM lagged",
    "avail": "SELECT panel_id, series_id, period, value, CASE lag_unit WHEN 'days' THEN ref + lag_value * INTERVAL 1 DAY WHEN 'weeks' THEN ref + lag_value * 7 * INTERVAL 1 DAY ELSE ref + lag_value * INTERVAL 1 MONTH END AS available_at FROM refd",
    "span": f"SELECT min(lo) AS s, last_day(max(hi) + INTERVAL {LEAD} MONTH) AS e FROM spans",
    "asofs": "SELECT last_day(m)::DATE AS as_of FROM (SELECT unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS m FROM span)",
    "vint": "SELECT as_of, panel_id, series_id, period, CASE WHEN available_at <= as_of::TIMESTAMP THEN value END AS value FROM avail, asofs",
    "mlags": "SELECT n_name AS series_id, n_nationkey % 3 AS lag FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 'TOTAL', 3",
    "tm": "SELECT panel_id, period AS target_period, sum(value::DECIMAL(20,2))::DOUBLE AS y FROM obs GROUP BY ALL",
    "tl": "SELECT *, lag(y) OVER w AS y_lag, row_number() OVER w - 1 AS i FROM tm WINDOW w AS (PARTITION BY panel_id ORDER BY target_period)",
    "ar": "SELECT *, CASE WHEN i >= 10 THEN regr_intercept(y, y_lag) OVER w + regr_slope(y, y_lag) OVER w * y_lag END AS y_pred FROM tl WINDOW w AS (PARTITION BY panel_id ORDER BY target_period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "mn": "SELECT *, CASE WHEN i >= 10 THEN avg(y) OVER w END AS y_pred FROM tl WINDOW w AS (PARTITION BY panel_id ORDER BY target_period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "fc": "SELECT panel_id, 'ar1' AS model_id, target_period, y AS y_true, y_pred FROM ar UNION ALL SELECT panel_id, 'mean', target_period, y, CASE WHEN month(target_period) <> 7 THEN y_pred END FROM mn",
    "upd": "SELECT panel_id, last_day(target_period)::DATE AS as_of, (target_period + ((3 - month(target_period) % 3) % 3) * INTERVAL 1 MONTH)::DATE AS target_quarter, 'DFM_r' || k || '_p1' AS model_id, CASE WHEN (month(target_period) + k) % 6 <> 0 THEN y * (0.8::DOUBLE + k * 0.1::DOUBLE) END AS value, (month(target_period) + k) % 5 <> 0 AS ok, CASE WHEN (month(target_period) + k) % 7 = 0 THEN false END AS converged, CASE WHEN (month(target_period) + 2 * k) % 11 = 0 THEN 'singular' END AS error FROM tm, (SELECT unnest(range(1, 5)) AS k)",
    "upf": "SELECT *, error IS NOT NULL OR NOT coalesce(ok, true) OR NOT coalesce(converged, true) AS bad FROM upd",
    "tq": "SELECT panel_id, period AS target_period, value AS y FROM obst WHERE series_id = 'TOTAL'",
}
NEEDS = {"span": ["spans"], "asofs": ["span"], "obst": ["obs"], "spans": ["obst"], "grid": ["spans"], "lags": ["raw"], "lagged": ["grid", "lags"], "refd": ["lagged"], "avail": ["refd"], "vint": ["avail", "asofs"], "tm": ["obs"], "tl": ["tm"], "ar": ["tl"], "mn": ["tl"], "fc": ["ar", "mn"], "upd": ["tm"], "upf": ["upd"], "tq": ["obst"]}


def with_tables(needed: str, body: str, more: str = "") -> str:
    """The SQL ``body`` with the common tables it needs before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for name in needed.split():
        visit(name)
    parts = [f"{name} AS ({CTE[name]})" for name in order] + ([more] if more else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
