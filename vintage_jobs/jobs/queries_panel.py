"""Registered queries: reading, grids, transformations and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintage_jobs.functions import dates as D
from vintage_jobs.functions import scalars as S
from vintage_jobs.jobs import fixtures as X
from vintage_jobs.jobs.fixtures import with_tables as W
from vintage_jobs.jobs.registry import CORE
from vintage_jobs.operators import catalog as C
from vintage_jobs.operators import transform as T
from vintage_jobs.sources import lags as L
from vintage_jobs.sources import panels as P

CHANGE, RATE = ["NATION_3", "NATION_8"], ["NATION_1", "NATION_6", "NATION_11"]


@CORE.add("s1_coerced_panel", "WITH e AS (SELECT event_type AS panel_id, CASE WHEN event_id % 10 <> 3 THEN (ts::DATE) END AS period, CASE WHEN event_id % 7 <> 0 THEN value END AS a, user_id::DOUBLE AS b FROM events) SELECT panel_id, 'a' AS series_id, period, a AS value FROM e WHERE period IS NOT NULL UNION ALL SELECT panel_id, 'b', period, b FROM e WHERE period IS NOT NULL")
def s1(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    wide = e.select(F.col("event_type").alias("panel_id"), F.when(F.col("event_id") % 10 == 3, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "NaN").otherwise("n/a")).otherwise(F.col("value").cast("string")).alias("a"), F.col("user_id").cast("string").alias("b"))
    return P.coerced_panel(wide, ["a", "b"])


@CORE.add("s2_monthly_grid", W("grid", "SELECT * FROM grid"))
def s2(spark, sf_dir):
    return X.panel(spark, sf_dir)


@CORE.add("s3_cleaned_lags", W("raw", "SELECT series_id AS series, d AS lag_days, w AS lag_weeks, m AS lag_months, 'M' AS freq, 'period_end' AS ref_point FROM raw WHERE k % 5 <> 0 UNION ALL SELECT '\"' || series_id || '\"', d, w, m, 'M', 'period_end' FROM raw WHERE k % 5 = 0 UNION ALL SELECT 'TOTAL', 45, NULL, NULL, 'Q', 'period_end'"))
def s3(spark, sf_dir):
    raw = L.nation_raw_lags(spark, sf_dir)
    return L.cleaned_lags(raw.select(F.col("series").alias("Data_seminar"), F.col("lag_days").alias("Lags_days"), F.col("lag_weeks").alias("Lags_weeks"), F.col("lag_months").alias("Lags_months")))


@CORE.add("s4_release_lags", W("lags", "SELECT * FROM lags"))
def s4(spark, sf_dir):
    return X.lags(spark, sf_dir)


@CORE.add("p2_nonempty_periods", W("grid", "SELECT * FROM grid g WHERE EXISTS (SELECT 1 FROM grid h WHERE h.panel_id = g.panel_id AND h.period = g.period AND h.value IS NOT NULL)"))
def p2(spark, sf_dir):
    return T.without_empty_periods(X.panel(spark, sf_dir))


@CORE.add("p3_without_first_periods", W("grid", "SELECT panel_id, series_id, period, value FROM (SELECT *, dense_rank() OVER (PARTITION BY panel_id ORDER BY period) AS r FROM grid) WHERE r > 2"))
def p3(spark, sf_dir):
    return T.without_first_periods(X.panel(spark, sf_dir), 2)


@CORE.add("p4_usable_series", W("obst", "SELECT * FROM obst o WHERE (SELECT stddev_samp(value) FROM obst i WHERE i.panel_id = o.panel_id AND i.series_id = o.series_id) > 0"))
def p4(spark, sf_dir):
    return T.usable_series(P.with_target(X.observations(spark, sf_dir)))


@CORE.add("p8_history_gates", W("grid", "SELECT panel_id, series_id, count(value) AS n, count(DISTINCT value) AS n_distinct, count(value) >= 25 AND count(DISTINCT value) > 2 AS can_test, count(value) >= 36 AS can_adjust, count(*) >= 60 AS can_mix FROM grid GROUP BY panel_id, series_id"))
def p8(spark, sf_dir):
    p = X.panel(spark, sf_dir)
    own = T.profiles(p).join(p.groupBy("panel_id", "series_id").agg(F.count("*").alias("months")), ["panel_id", "series_id"])
    return own.select("panel_id", "series_id", "n", "n_distinct", ((F.col("n") >= 25) & (F.col("n_distinct") > 2)).alias("can_test"), (F.col("n") >= 36).alias("can_adjust"), (F.col("months") >= 60).alias("can_mix"))


@CORE.add("a9_series_profile", W("grid", "SELECT panel_id, series_id, count(value - 60000) AS n, count(DISTINCT value) AS n_distinct, coalesce(bool_or(value < 60000), false) AS any_negative, coalesce(bool_or(value = 60000), false) AS any_zero FROM grid GROUP BY panel_id, series_id"))
def a9(spark, sf_dir):
    return T.profiles(X.panel(spark, sf_dir).withColumn("value", F.col("value") - 60000))


@CORE.add("a3_z_scores", W("grid", "SELECT panel_id, series_id, period, value, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z FROM grid WINDOW w AS (PARTITION BY panel_id, series_id)"))
def a3(spark, sf_dir):
    return T.z_scores(X.panel(spark, sf_dir)).withColumn("z", F.round("z", 6))


@CORE.add("a3_z_scores_point_in_time", W("grid", "SELECT panel_id, series_id, period, value, round(CASE WHEN stddev_pop(value) OVER w > 1e-6 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z FROM grid WINDOW w AS (PARTITION BY panel_id, series_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def a3_then(spark, sf_dir):
    return T.z_scores(X.panel(spark, sf_dir), point_in_time=True).withColumn("z", F.round("z", 6))


@CORE.add("a8_last_of_quarter", W("obs", "SELECT panel_id, series_id, date_trunc('quarter', period)::DATE AS quarter, arg_max(value, period) AS value FROM obs GROUP BY ALL"))
def a8(spark, sf_dir):
    return X.observations(spark, sf_dir).where("value IS NOT NULL").groupBy("panel_id", "series_id", D.quarter_start(F.col("period")).alias("quarter")).agg(F.max_by("value", "period").alias("value"))


@CORE.add("a13_effective_size", W("grid", "SELECT panel_id, count(DISTINCT CASE WHEN value IS NOT NULL THEN period END) AS t_eff, count(DISTINCT series_id) AS n_eff, least(6, count(DISTINCT CASE WHEN value IS NOT NULL THEN period END), count(DISTINCT series_id)) AS k FROM grid GROUP BY panel_id"))
def a13(spark, sf_dir):
    return T.effective_size(X.panel(spark, sf_dir))


@CORE.add("w1_differences", W("grid", "SELECT panel_id, series_id, period, round(value - lag(value) OVER (PARTITION BY panel_id, series_id ORDER BY period), 2) AS diff FROM grid"))
def w1(spark, sf_dir):
    return T.differences(X.panel(spark, sf_dir)).select("panel_id", "series_id", "period", F.round("diff", 2).alias("diff"))


LOGS = "sh AS (SELECT panel_id, series_id, period, CASE WHEN series_id IN ('NATION_0', 'NATION_5') THEN value - 10000000 WHEN series_id = 'NATION_7' AND month(period) = 6 THEN 0 ELSE value END AS v FROM grid), lg AS (SELECT *, CASE WHEN coalesce(bool_or(v < 0) OVER s, false) THEN NULL WHEN coalesce(bool_or(v = 0) OVER s, false) THEN ln(1 + v) ELSE ln(v) END AS l FROM sh WINDOW s AS (PARTITION BY panel_id, series_id)), df AS (SELECT *, l - lag(l) OVER o AS ld, v - lag(v) OVER o AS d FROM lg WINDOW o AS (PARTITION BY panel_id, series_id ORDER BY period))"


@CORE.add("w2_log_differences", W("grid", "SELECT panel_id, series_id, period, round(CASE WHEN count(ld) OVER s < 10 AND count(v) OVER s > 25 THEN d ELSE ld END, 6) AS change FROM df WINDOW s AS (PARTITION BY panel_id, series_id)", LOGS))
def w2(spark, sf_dir):
    s = F.col("series_id")
    moved = F.when(s.isin("NATION_0", "NATION_5"), F.col("value") - 10000000).when((s == "NATION_7") & (F.month("period") == 6), 0.0).otherwise(F.col("value"))
    return T.log_differences(X.panel(spark, sf_dir).withColumn("value", moved)).select("panel_id", "series_id", "period", F.round("change", 6).alias("change"))


@CORE.add("w3_second_differences", W("grid", "SELECT panel_id, series_id, period, CASE WHEN series_id IN (SELECT n_name FROM nation WHERE n_nationkey % 4 = 1) THEN round(value - lag(value) OVER (PARTITION BY panel_id, series_id ORDER BY period), 2) ELSE round(value, 2) END AS value FROM grid"))
def w3(spark, sf_dir):
    still = P.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 1").select(F.col("n_regionkey").cast("string").alias("panel_id"), F.col("n_name").alias("series_id"))
    return T.second_differences(X.panel(spark, sf_dir), still, P.TARGET).withColumn("value", F.round("value", 2))


GROWTH = "q AS (SELECT panel_id, date_trunc('quarter', period)::DATE AS quarter, arg_max(value, period) AS v FROM grid WHERE series_id = 'TOTAL' AND value IS NOT NULL GROUP BY ALL), gr AS (SELECT panel_id, quarter, round(ln(nullif(v, 0)) - lag(ln(nullif(v, 0))) OVER (PARTITION BY panel_id ORDER BY quarter), 8) AS growth FROM q)"


@CORE.add("w4_quarterly_growth", W("grid", "SELECT * FROM gr", GROWTH))
def w4(spark, sf_dir):
    return T.quarterly_growth(X.panel(spark, sf_dir), P.TARGET).withColumn("growth", F.round("growth", 8))


@CORE.add("j12_growth_on_dates", W("grid", "SELECT g.panel_id, series_id, period, growth AS value FROM grid g LEFT JOIN gr ON g.panel_id = gr.panel_id AND date_trunc('quarter', period)::DATE = quarter WHERE series_id = 'TOTAL' AND value IS NOT NULL", GROWTH))
def j12(spark, sf_dir):
    return T.growth_on_dates(X.panel(spark, sf_dir), P.TARGET).withColumn("value", F.round("value", 8))


PVALUES = "pv AS (SELECT n_regionkey::VARCHAR AS panel_id, n_name AS series_id, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey % 4 * 0.02 END AS p FROM nation)"
RULES = f"""dec AS (SELECT panel_id, series_id, CASE WHEN series_id IN ('NATION_3', 'NATION_8') THEN '{S.RULE_CHANGE}' WHEN coalesce(p <= 0.05, false) THEN '{S.RULE_LEVEL}' WHEN series_id IN ('NATION_1', 'NATION_6', 'NATION_11') THEN '{S.RULE_DIFF}' ELSE '{S.RULE_LOG}' END AS rule FROM pv UNION ALL SELECT DISTINCT panel_id, 'TOTAL', '{S.RULE_TARGET}' FROM pv)"""


def p_values(spark, sf_dir):
    k = F.col("n_nationkey")
    return P.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("panel_id"), F.col("n_name").alias("series_id"), F.when(k % 6 != 5, k % 4 * 0.02).alias("p_value"))


@CORE.add("f7_transform_rules", W("", f"WITH {PVALUES}, {RULES} SELECT * FROM dec"))
def f7(spark, sf_dir):
    return T.decisions(p_values(spark, sf_dir), P.TARGET, CHANGE, RATE).select("panel_id", "series_id", "rule")


@CORE.add(
    "wl1_transformed_panel",
    W(
        "grid",
        f"SELECT panel_id, series_id, period, round(CASE WHEN rule LIKE 'level%' THEN value WHEN rule LIKE 'diff%' THEN d ELSE ld END, 6) AS value FROM (SELECT g.*, rule, value - lag(value) OVER w AS d, ln(value) - lag(ln(value)) OVER w AS ld FROM grid g JOIN dec USING (panel_id, series_id) WHERE series_id <> 'TOTAL' WINDOW w AS (PARTITION BY panel_id, series_id ORDER BY period)) UNION ALL SELECT g.panel_id, series_id, period, CASE WHEN value IS NOT NULL THEN round(growth, 6) END FROM grid g LEFT JOIN gr ON g.panel_id = gr.panel_id AND date_trunc('quarter', period)::DATE = quarter WHERE series_id = 'TOTAL'",
        f"{PVALUES}, {RULES}, {GROWTH}",
    ),
)
def wl1(spark, sf_dir):
    rules = T.decisions(p_values(spark, sf_dir), P.TARGET, CHANGE, RATE)
    out = T.transformed(X.panel(spark, sf_dir), rules, P.TARGET)
    growth = F.when(F.col("series_id") == P.TARGET, F.round(F.round("value", 8), 6)).otherwise(F.round("value", 6))
    return out.withColumn("value", growth)


@CORE.add("f15_labels", W("upd", "SELECT DISTINCT model_id || '|' || year(target_quarter) || 'Q' || quarter(target_quarter) || '|' || strftime(as_of, '%Y-%m-%d') AS cache_key, 'vintage_' || strftime(as_of, '%Y-%m-%d') AS file FROM upd"))
def f15(spark, sf_dir):
    return X.updates(spark, sf_dir).select(S.cache_key(F.col("model_id"), D.quarter_label(F.col("target_quarter")), F.col("as_of")).alias("cache_key"), S.vintage_name(F.col("as_of")).alias("file")).distinct()


@CORE.add("f16_unquoted", "SELECT o_orderkey, trim(o_orderpriority) AS name FROM orders")
def f16(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    quoted = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(' "'), F.col("o_orderpriority"), F.lit(' "'))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("'"), F.col("o_orderpriority"), F.lit("' "))).otherwise(F.concat(F.lit("  "), F.col("o_orderpriority")))
    return o.select("o_orderkey", S.unquoted(quoted).alias("name"))


@CORE.add("f17_horizon", "SELECT DISTINCT o_orderdate::DATE AS train_end, (date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE AS target, greatest(1, (year(date_trunc('quarter', o_orderdate)) - year(o_orderdate)) * 12 + month(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) - month(o_orderdate)) AS h FROM orders")
def f17(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("train_end")).distinct()
    target = F.add_months(D.quarter_start(F.col("train_end")), 2)
    return o.select("train_end", target.alias("target"), D.horizon_months(F.col("train_end"), target).cast("long").alias("h"))


@CORE.add("f18_kernel", "SELECT event_id, round(CASE WHEN u BETWEEN -1 AND 0 THEN 0.75 * (1 - u * u) ELSE 0 END, 8) AS k FROM (SELECT event_id, (value - 60) / 50 AS u FROM events)")
def f18(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(S.epanechnikov((F.col("value") - 60) / 50), 8).alias("k"))


@CORE.add("j14_header_matches", "WITH c AS (SELECT 'part_' || p_partkey AS file, p_type AS folder, string_split(p_name, ' ') AS w FROM part), k AS (SELECT DISTINCT unnest([upper(w), upper(w)[1:3]]) AS keyword FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)) SELECT file, folder, keyword, [x for x in w if contains(lower(x), lower(keyword))][1] AS column_name FROM c, k WHERE len([x for x in w if contains(lower(x), lower(keyword))]) > 0")
def j14(spark, sf_dir):
    part = P.table(spark, sf_dir, "part")
    catalog = part.select(F.concat(F.lit("part_"), "p_partkey").alias("file"), F.col("p_type").alias("folder"), F.regexp_replace("p_name", " ", ";").alias("header"), F.lit(";").alias("sep"))
    words = part.select(F.explode(F.split(F.upper("p_name"), " ")).alias("w"))
    keywords = words.select(F.explode(F.array("w", F.substring("w", 1, 3))).alias("keyword")).distinct()
    return C.header_matches(catalog, keywords)


@CORE.add("j15_line_matches", "WITH n AS (SELECT unnest(list_distinct(string_split_regex(text, '\\s+') || string_split(text, chr(10)))) AS needle, 'item ' || item_id AS why FROM benchmark), l AS (SELECT doc_id::VARCHAR AS file, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) SELECT file, line_no, line, min(why) AS why FROM l JOIN (SELECT needle, min(why) AS why FROM n WHERE needle <> '' GROUP BY needle) n ON contains(line, needle) GROUP BY ALL")
def j15(spark, sf_dir):
    """Every word and every whole line of the benchmark, in every line of the documents."""
    items = C.text_words(P.table(spark, sf_dir, "benchmark"), F.concat(F.lit("item "), "item_id"))
    return C.line_matches(C.text_lines(P.table(spark, sf_dir, "documents")), items).withColumn("line_no", F.col("line_no").cast("long"))


@CORE.add("u2_distinct_releases", W("obs", "SELECT DISTINCT panel_id, series_id, date_trunc('quarter', period)::DATE AS quarter FROM obs"))
def u2(spark, sf_dir):
    return X.observations(spark, sf_dir).select("panel_id", "series_id", D.quarter_start(F.col("period")).alias("quarter")).dropDuplicates()
