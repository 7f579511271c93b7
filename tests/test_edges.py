"""Hand-made rows for the rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vintage_jobs.functions import dates as D
from vintage_jobs.functions import scalars as S
from vintage_jobs.operators import combine as C
from vintage_jobs.operators import evaluate as E
from vintage_jobs.operators import features as T
from vintage_jobs.operators import schedule as R
from vintage_jobs.operators import transform as X
from vintage_jobs.operators import vintage as V
from vintage_jobs.sources import lags as L
from vintage_jobs.sources import panels as P

PANEL = "panel_id string, series_id string, period date, value double"


def d(text):
    return dt.date.fromisoformat(text)


def panel(spark, *rows):
    return spark.createDataFrame([("p", s, d(t), v) for s, t, v in rows], PANEL)


def lag_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "series_id string, freq string, ref_point string, lag_unit string, lag_value int")


def asofs(spark, *days):
    return spark.createDataFrame([(d(x),) for x in days], "as_of date")


def test_period_end_is_not_out_at_midnight_of_its_last_day(spark):
    rows = panel(spark, ("a", "2000-01-01", 1.0), ("b", "2000-01-01", 2.0))
    lags = lag_rows(spark, ("a", "M", "period_end", "days", 0), ("b", "M", "period_start", "days", 30))
    seen = V.published(rows, lags, asofs(spark, "2000-01-31", "2000-02-01"))
    assert {(r.as_of, r.series_id) for r in seen.collect()} == {(d("2000-01-31"), "b"), (d("2000-02-01"), "a"), (d("2000-02-01"), "b")}
    by_day = V.published(rows, lags, asofs(spark, "2000-01-31"), inclusive_day=True)
    assert {r.series_id for r in by_day.collect()} == {"a", "b"}
    assert {r.as_of for r in R.release_days(rows, lags, V.fixed_span(spark, "2000-01-01", "2000-02-28")).collect()} == {d("2000-01-31")}


def test_later_values_never_change_a_vintage(spark):
    rows = [("a", f"2000-{m:02d}-01", float(m)) for m in range(1, 13)]
    lags = lag_rows(spark, ("a", "M", "period_end", "weeks", 2))
    grid = asofs(spark, "2000-04-20", "2000-08-01")
    changed = [(s, t, v if t < "2000-07-01" else 99.0) for s, t, v in rows]
    make = lambda r: sorted(map(str, V.vintages(panel(spark, *r), lags, grid).collect()))
    assert make(rows) == make(changed)


def test_vintages_grow_and_sum_to_the_manifest(spark):
    rows = [("a", f"2000-{m:02d}-01", float(m) if m % 4 else None) for m in range(1, 13)] + [("b", f"2000-{m:02d}-01", 1.0) for m in range(1, 13)]
    lags = lag_rows(spark, ("a", "M", "period_end", "months", 1))
    grid = asofs(spark, "2000-03-31", "2000-06-30", "2000-12-31", "2001-06-30")
    counts = {r.as_of: r.n for r in V.vintages(panel(spark, *rows), lags, grid).groupBy("as_of").agg(F.count("value").alias("n")).collect()}
    assert [counts[k] for k in sorted(counts)] == sorted(counts.values())
    assert {r.as_of: round((1 - r.na_share) * r.n_rows * r.n_cols) for r in V.manifest(panel(spark, *rows), lags, grid).collect()} == counts


def test_lag_rules(spark):
    raw = spark.createDataFrame(
        [("'a'", None, 2, 3, "q", "period_start", 0), (" b ", 1, 2, 3, "X", "bad", 1), ("c", None, None, None, "M", "period_end", 2), ("nan", 1, None, None, "M", "x", 3), ("a", None, None, 5, "timestamp", "x", 4)],
        "series string, lag_days int, lag_weeks int, lag_months int, freq string, ref_point string, n int",
    )
    got = {r.series_id: tuple(r)[1:] for r in L.release_lags(raw, "n").collect()}
    assert got == {"a": ("timestamp", "timestamp", "months", 5), "b": ("M", "period_end", "days", 1)}
    with pytest.raises(Exception, match="negative lag"):
        L.release_lags(raw.withColumn("lag_days", F.lit(-1)), "n").collect()
    with pytest.raises(Exception, match="unknown lag unit"):
        V.with_availability(panel(spark, ("a", "2000-01-01", 1.0)), lag_rows(spark, ("a", "M", "period_end", "years", 1))).collect()


def test_unlisted_series_have_the_default_lag(spark):
    seen = V.published(panel(spark, ("z", "2000-01-01", 1.0)), lag_rows(spark), asofs(spark, "2000-01-31", "2000-02-29"))
    assert [r.as_of for r in seen.collect()] == [d("2000-02-29")]


def test_target_quarter_of_the_worked_example(spark):
    rows = panel(spark, *(("GDP", f"{y}-{m:02d}-01", 1.0) for y in (2009, 2010) for m in (3, 6, 9, 12)))
    lags = lag_rows(spark, ("GDP", "Q", "period_end", "days", 45))
    got = {r.as_of: r.quarter for r in V.target_quarters(rows, lags, asofs(spark, "2010-01-31", "2010-02-28"), "GDP").collect()}
    assert got == {d("2010-01-31"): d("2009-10-01"), d("2010-02-28"): d("2010-01-01")}
    assert V.target_quarters(rows, lags, asofs(spark, "2030-01-31"), "GDP").first().quarter == d("2013-01-01")
    with pytest.raises(Exception, match="quarterly"):
        V.target_quarters(rows, lag_rows(spark, ("GDP", "M", "period_end", "days", 45)), asofs(spark, "2010-01-31"), "GDP").collect()


def test_release_calendars(spark):
    rules = spark.createDataFrame(
        [("fixed", None, 31, None, None), ("fifth", None, None, 5, 0), ("dates", "2001-02-30;2001-03-03; 2001-01-09 ;x;2001-03-03;2009-01-01", 4, None, None), ("none", None, None, 0, 2)],
        "series_id string, release_dates string, release_day_in_month int, release_week_in_month int, release_weekday int",
    )
    got = {}
    for r in R.calendar_releases(rules, V.fixed_span(spark, "2001-01-01", "2001-03-31")).collect():
        got.setdefault(r.series_id, []).append(r.day.isoformat())
    assert {k: sorted(v) for k, v in got.items()} == {"fixed": ["2001-01-31", "2001-02-28", "2001-03-31"], "fifth": ["2001-01-29", "2001-02-26", "2001-03-26"], "dates": ["2001-01-09", "2001-03-03"]}


def test_grid_drops_off_grid_dates_and_fills_gaps(spark):
    got = P.monthly_grid(panel(spark, ("a", "2000-01-01", 1.0), ("a", "2000-02-15", 9.0), ("a", "2000-04-01", 2.0)))
    assert [(r.period.isoformat(), r.value) for r in got.orderBy("period").collect()] == [("2000-01-01", 1.0), ("2000-02-01", None), ("2000-03-01", None), ("2000-04-01", 2.0)]


def test_coerced_panel(spark):
    wide = spark.createDataFrame([("p", "2000-01-01", "1.5", "NaN"), ("p", "nope", "1", "2"), ("p", "2000-02-01", "x", "")], "panel_id string, date string, a string, b string")
    assert sorted((r.series_id, r.period.isoformat(), r.value) for r in P.coerced_panel(wide, ["a", "b"]).collect() if r.value is not None) == [("a", "2000-01-01", 1.5)]
    assert P.coerced_panel(wide, ["a", "b"]).count() == 4


def test_log_rules(spark):
    def series(values):
        return panel(spark, *(("a", (dt.date(2000, 1, 1) + dt.timedelta(days=i)).isoformat(), v) for i, v in enumerate(values)))

    change = lambda v: [r.change for r in X.log_differences(series(v)).orderBy("period").collect()]
    assert change([1.0, 0.0, 3.0])[2] == pytest.approx(1.3862943611)
    assert change([1.0, -1.0, 3.0]) == [None, None, None]
    assert change([float(i - 5) for i in range(30)])[1:] == [1.0] * 29
    assert change([1.0, None, 2.0, 4.0])[1:3] == [None, None]


def test_zero_deviation(spark):
    rows = panel(spark, ("a", "2000-01-01", 5.0), ("a", "2000-02-01", 5.0))
    assert [r.z for r in X.z_scores(rows).collect()] == [None, None]
    assert [r.z for r in V.standardised_vintages(rows.withColumn("as_of", F.lit("2000-03-01"))).collect()] == [0.0, 0.0]
    assert X.usable_series(rows).count() == 0 and X.usable_series(panel(spark, ("a", "2000-01-01", 5.0))).count() == 0


def test_growth_over_a_gap_quarter(spark):
    rows = panel(spark, ("g", "2000-03-01", 1.0), ("g", "2000-02-01", 7.0), ("g", "2000-09-01", 2.718281828459045), ("g", "2000-12-01", 0.0))
    got = [(r.quarter.isoformat(), r.growth) for r in X.quarterly_growth(rows, "g").orderBy("quarter").collect()]
    assert got[0] == ("2000-01-01", None) and got[1][1] == pytest.approx(1.0) and got[2][1] is None


def test_phase_tie_goes_to_the_first_seen(spark):
    rows = panel(spark, ("g", "2000-02-01", 1.0), ("g", "2000-03-01", 1.0), ("g", "2000-06-01", 1.0), ("g", "2000-05-01", 1.0))
    assert V.target_phase(rows, "g").first().phase == 2


def test_ar1_with_constant_history(spark):
    t = spark.createDataFrame([("p", dt.date(2000, m, 1), 2.0) for m in range(1, 8)], "panel_id string, target_period date, y double")
    got = [r.y_pred for r in E.expanding_ar1(t, least=3).orderBy("target_period").collect()]
    assert got[:3] == [None] * 3 and got[4] == pytest.approx(2 * 2 * 2 / 5 + 2 / 5)


def test_metrics_skip_infinite_pairs(spark):
    f = spark.createDataFrame([("p", "m", dt.date(2000, i, 1), y, z) for i, (y, z) in enumerate([(1.0, 2.0), (1.0, float("inf")), (float("nan"), 1.0), (None, 1.0)], 1)], "panel_id string, model_id string, target_period date, y_true double, y_pred double")
    m = E.metrics(f).first()
    assert (m.n, m.fmse, m.mae) == (1, 1.0, 1.0)
    assert E.metrics(f.withColumn("y_pred", F.lit(None).cast("double"))).first().fmse is None
    with pytest.raises(ValueError):
        E.loss_differences(f, "a", "b", "cubic")


RECORD = "panel_id string, as_of date, target_quarter date, model_id string, value double, ok boolean, converged boolean, error string"


def records(spark, *rows):
    return spark.createDataFrame([("p", d(a), d("2000-03-01"), m, v, ok, c, e) for a, m, v, ok, c, e in rows], RECORD)


def test_mixture_rules(spark):
    bounds = spark.createDataFrame([("p", 0.0, 10.0)], "panel_id string, lo double, hi double")
    rows = records(spark, ("2000-01-31", "a", 12.0, True, True, None), ("2000-01-31", "b", 4.0, None, None, None), ("2000-01-31", "c", 6.0, True, False, None), ("2000-01-31", "d", None, True, True, None), ("2000-02-29", "a", 3.0, False, None, None))
    got = {r.as_of: r for r in C.mixture(rows, bounds).collect()}
    one = got[d("2000-01-31")]
    assert (one.mixture, one.n_used, one.n_failed, one.n_trimmed, one.models_used) == (7.0, 2, 2, 1, ["a", "b"])
    assert got[d("2000-02-29")].mixture is None
    assert {r.as_of: r.mixture for r in C.mixture(rows, bounds, drop_failed=False).collect()}[d("2000-02-29")] == 3.0
    fallback = spark.createDataFrame([("p", d("2000-02-29"), d("2000-03-01"), 5.5)], "panel_id string, as_of date, target_quarter date, fallback_value double")
    assert {r.as_of: r.mixture for r in C.mixture(rows, bounds, fallback).collect()}[d("2000-02-29")] == 5.5
    with pytest.raises(Exception, match="all models failed"):
        C.checked(C.mixture(rows, bounds)).collect()
    strict = {r.as_of: r for r in C.mixture(rows, bounds, strict_reference=True).collect()}[d("2000-01-31")]
    assert (strict.n_failed, strict.n_trimmed, strict.models_used, strict.mixture) == (1, 2, ["a", "b", "d"], 7.0)


def test_fallback_takes_a_failed_previous_update_first(spark):
    rows = records(spark, ("2000-01-31", "m", 1.0, True, True, None), ("2000-02-29", "m", 2.0, False, None, None), ("2000-03-31", "m", 3.0, True, False, None), ("2000-04-30", "m", None, True, True, None), ("2000-05-31", "m", 9.0, True, True, "bad"))
    got = [(r.source, r.final_value) for r in C.with_fallback(rows).orderBy("as_of").collect()]
    assert got == [("ok", 1.0), ("previous_update", 1.0), ("previous_update", 2.0), ("previous_update", 3.0), ("none", None)]
    other = [(r.source, r.final_value) for r in C.with_fallback(rows, prefer_previous_update=False).orderBy("as_of").collect()]
    assert other[2] == ("previous_valid", 1.0) and other[4] == ("none", None)


def test_criterion_ties_go_to_fewer_factors(spark):
    fits = spark.createDataFrame([("p", 1, 3, 2.0), ("p", 1, 1, 2.0), ("p", 1, 2, float("nan")), ("p", 2, 1, float("inf"))], "panel_id string, target_period int, k int, bic double")
    assert [(r.target_period, r.k) for r in C.best_by_criterion(fits).collect()] == [(1, 1)]


def test_choices_and_rules(spark):
    row = spark.range(1).select(*(S.choice(F.lit(x).cast("double")).alias(n) for n, x in (("a", -1.0), ("b", 1.0), ("t", 1e-13), ("n", None))), S.clipped(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)).alias("c"), S.unquoted(F.lit(" 'x\" ")).alias("u")).first()
    assert tuple(row) == ("modelA", "modelB", "tie", "na", None, "'x\"")
    assert spark.range(1).select(D.horizon_months(F.lit(d("2000-05-01")), F.lit(d("2000-03-01")))).first()[0] == 1
    with pytest.raises(ValueError):
        D.asof_month(F.lit(d("2000-05-01")), "late")


def test_decisions_of_the_published_table(spark):
    """P-values and rules of the published decision table, in its order."""
    table = [(0.6495311577483545, "log"), (0.0021492432087280677, "level"), (0.995911019225898, "log"), (0.9931449423443606, "log"), (0.00898514701339036, "level"), (0.019356163197686998, "level"), (0.0012336875200212943, "change"), (0.6729428840496852, "diff"), (0.0035742262720888066, "level"), (0.012293552311668307, "level"), (0.016352743888081635, "level"), (0.009724249935096782, "level"), (0.031103926124083792, "change"), (0.014066952625039842, "level"), (0.015039572203237522, "level"), (0.0074846853190573765, "level"), (0.9820532770987117, "log"), (0.6869113788412298, "diff"), (0.30919003081455443, "diff")]
    names = {"log": S.RULE_LOG, "level": S.RULE_LEVEL, "change": S.RULE_CHANGE, "diff": S.RULE_DIFF}
    p = spark.createDataFrame([("p", f"s{i}", v) for i, (v, _) in enumerate(table)], "panel_id string, series_id string, p_value double")
    got = {r.series_id: r.rule for r in X.decisions(p, "gdp", [f"s{i}" for i, (_, k) in enumerate(table) if k == "change"], [f"s{i}" for i, (_, k) in enumerate(table) if k == "diff"]).collect()}
    assert got == {f"s{i}": names[k] for i, (_, k) in enumerate(table)} | {"gdp": S.RULE_TARGET}


def test_split_needs_rows(spark):
    t = spark.createDataFrame([("p", dt.date(2000, m, 1), 2.0) for m in range(1, 7)], "panel_id string, target_period date, y double")
    assert sum(r.is_validation for r in T.chronological_split(t, 0.1).collect()) == 1
    assert not any(r.is_validation for r in T.chronological_split(t, 0.0).collect())
    with pytest.raises(Exception, match="too few rows"):
        T.chronological_split(t, 0.5).collect()
    assert R.order_violations(spark.createDataFrame([("p", 1, d("2000-01-01")), ("p", 2, d("2000-01-01")), ("p", 3, d("2000-02-01"))], "panel_id string, seq int, as_of date")).count() == 1


def test_sinks(spark, tmp_path):
    rows = panel(spark, ("a", "2000-01-01", 1.0), ("b", "2000-01-01", None)).withColumn("as_of", F.lit(d("2000-02-01")))
    P.write_vintages(rows, str(tmp_path / "v"))
    P.write_vintages(rows.withColumn("as_of", F.lit(d("2000-03-01"))), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).groupBy("as_of").count().count() == 2
    P.write_panel(P.wide_panel(rows, ["a", "b"]), str(tmp_path / "w"), "csv")
    with pytest.raises(ValueError):
        P.write_panel(rows, str(tmp_path / "x"), "xls")
    (tmp_path / "c.csv").write_text("date,a\n2000-01-01,1\nbad,2\n")
    assert P.read_csv_panel(spark, str(tmp_path / "c.csv")).count() == 1


#: Tests and rules of a published panel (p-value, rule), already-change and rate-like series as below.
DECIDED = [
    ("Bankruptcies", 0.6495, S.RULE_LOG), ("BusinessLeadIndicator_NLD", 0.0021, S.RULE_LEVEL), ("CPI_1", 0.9959, S.RULE_LOG), ("Construction_proxy", 0.9931, S.RULE_LOG), ("ConsumLeadIndicator_NLD", 0.0090, S.RULE_LEVEL),
    ("Crude oil, Brent", 0.0194, S.RULE_LEVEL), ("Domestic_consumption_by_households_VolumeChangesShoppingdayAdjusted_3", 0.0012, S.RULE_CHANGE), ("Employment_allGenders_15 to 74 years_SeasonallyAdjusted_8_UnemplyRate", 0.6729, S.RULE_DIFF),
    ("Exports_Europe", 0.0036, S.RULE_LEVEL), ("GrossDomesticProduct_1", None, S.RULE_TARGET), ("Imports_Europe", 0.0123, S.RULE_LEVEL), ("IndustProd_Europe_ImprtWeighted", 0.0164, S.RULE_LEVEL), ("Industry_proxy", 0.0097, S.RULE_LEVEL),
    ("MaandmutatieCPI_3", 0.0311, S.RULE_CHANGE), ("NL_Consumer_confidence", 0.0141, S.RULE_LEVEL), ("NL_Economic_sentiment_confidence", 0.0150, S.RULE_LEVEL), ("NL_Industrial_confidence", 0.0075, S.RULE_LEVEL), ("^AEX", 0.9821, S.RULE_LOG),
    ("ecb_10Y_Yield", 0.6869, S.RULE_DIFF), ("ecb_3M_Yield", 0.3092, S.RULE_DIFF),
]
CHANGE_SERIES = ["Domestic_consumption_by_households_VolumeChangesShoppingdayAdjusted_3", "MaandmutatieCPI_3"]
RATE_SERIES = ["Employment_allGenders_15 to 74 years_SeasonallyAdjusted_8_UnemplyRate", "ecb_10Y_Yield", "ecb_3M_Yield"]


def test_rules_of_a_published_panel(spark):
    from vintage_jobs.operators.transform import decisions

    p = spark.createDataFrame([("p", s, v) for s, v, _ in DECIDED], "panel_id string, series_id string, p_value double")
    got = {r.series_id: r.rule for r in decisions(p, "GrossDomesticProduct_1", CHANGE_SERIES, RATE_SERIES).collect()}
    assert got == {s: rule for s, _, rule in DECIDED}
