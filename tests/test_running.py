"""Two-level running aggregates, forward as-ofs and quantiles in time against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.operators import evaluate as E
from vintage_jobs.operators.running import previous, running

DAY = dt.date(1999, 11, 20)


def rows_of(rng, panels=("a", "b"), n=120):
    return [(p, DAY + dt.timedelta(days=11 * i), None if rng.random() < 0.15 else rng.uniform(-5, 5)) for p in panels for i in range(n)]


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_against_loops(spark, inclusive):
    rows = rows_of(random.Random(1))
    frame = spark.createDataFrame(rows, "panel_id string, at date, v double").repartition(3)
    made = running(frame, ["panel_id"], "at", {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "n": ("sum", F.lit(1))}, inclusive)
    back = previous(frame, ["panel_id"], "at", {"v1": "v", "at1": "at"})
    got = {(r.panel_id, r.at): r for r in made.collect()}
    last = {(r.panel_id, r.at): (r.v1, r.at1) for r in back.collect()}
    assert len(got) == len(last) == len(rows)
    for i, (p, at, _) in enumerate(rows):
        own = [r for r in rows[: i + inclusive] if r[0] == p]
        known = [v for *_, v in own if v is not None]
        r = got[p, at]
        assert r.s == (pytest.approx(sum(known)) if known else None) and (r.lo, r.hi) == ((min(known), max(known)) if known else (None, None))
        assert r.n == (len(own) or None)
        before = [r for r in rows[:i] if r[0] == p]
        assert last[p, at] == ((before[-1][2], before[-1][1]) if before else (None, None))


def test_a_long_panel_is_many_tasks(spark):
    """A panel of all rows: rows are dealt by panel and year, and what is dealt by panel alone is a row a year."""
    frame = spark.range(20_000).select(F.lit("a").alias("panel_id"), F.expr("date_add(date'1950-01-01', cast(id as int))").alias("at"), F.rand(1).alias("v"))
    made = running(frame, ["panel_id"], "at", {"s": ("sum", F.col("v"))}).withColumn("task", F.spark_partition_id())
    assert made.select("task").distinct().count() > 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__block" in plan


def test_autoregression_mean_and_rmse_against_loops(spark):
    rng = random.Random(4)
    rows = rows_of(rng, ("a",), 70) + [("flat", DAY + dt.timedelta(days=40 * i), 2.5) for i in range(30)] + [("large", DAY + dt.timedelta(days=40 * i), 1e8 + rng.random()) for i in range(40)]
    frame = spark.createDataFrame(rows, "panel_id string, target_period date, y double")
    ar = {(r.panel_id, r.target_period): r.y_pred for r in E.expanding_ar1(frame).collect()}
    mean = {(r.panel_id, r.target_period): r.y_pred for r in E.expanding_mean(frame).collect()}
    scored = frame.select("panel_id", F.lit("m").alias("model_id"), "target_period", F.col("y").alias("y_true"), F.when(F.month("target_period") == 3, float("nan")).otherwise(F.lit(1.0)).alias("y_pred"))
    rmse = {(r.panel_id, r.target_period): r.rmse for r in E.running_rmse(scored).collect()}
    for p in ("a", "flat", "large"):
        own = [(d, y) for q, d, y in rows if q == p]
        for i, (d, _) in enumerate(own):
            pairs = [(own[j - 1][1], own[j][1]) for j in range(1, i) if own[j][1] is not None and own[j - 1][1] is not None]
            past = [y for _, y in own[:i] if y is not None]
            assert mean[p, d] == (pytest.approx(np.mean(past)) if i >= 10 else None)
            x = own[i - 1][1] if i else None
            if i < 10 or x is None:
                assert ar[p, d] is None
            else:
                c = np.array([a for a, _ in pairs]).mean() if p == "large" else 0.0
                b, *_ = np.linalg.lstsq(np.array([[1.0, a - c] for a, _ in pairs]) if p != "flat" else np.array([[1.0, a] for a, _ in pairs]), np.array([b for _, b in pairs]), rcond=None)
                assert ar[p, d] == pytest.approx(b[0] + b[1] * (x - c), rel=1e-7)
            errors = [(y - 1.0) ** 2 for e, y in own[: i + 1] if y is not None and e.month != 3]
            assert rmse[p, d] == (pytest.approx(np.sqrt(np.mean(errors))) if errors else None)


@pytest.mark.parametrize("low, high", [(0.1, 0.9), (0.0, 1.0), (0.5, 0.37)])
def test_quantiles_in_time_against_numpy(spark, low, high):
    rng = random.Random(6)
    rows = rows_of(rng, ("a",), 200) + [("ties", DAY + dt.timedelta(days=9 * i), float(i % 3)) for i in range(90)] + [("one", DAY + dt.timedelta(days=700), 4.0), ("none", DAY, None)]
    days = [DAY + dt.timedelta(days=d) for d in (-5, 0, 30, 400, 800, 3000)]
    got = {(r.panel_id, r.as_of): (r.lo, r.hi) for r in E.quantiles_in_time(spark.createDataFrame(rows, "panel_id string, target_period date, y double"), spark.createDataFrame([(d,) for d in days], "as_of date"), low, high, buckets=8).collect()}
    assert len(got) == 4 * len(days)
    for (p, day), found in got.items():
        known = [y for q, d, y in rows if q == p and d <= day and y is not None]
        assert found == ((pytest.approx(np.quantile(known, low)), pytest.approx(np.quantile(known, high))) if known else (None, None))


def test_selection_begins_by_the_overlap_of_each_panel(spark):
    rows = [("long", i, 1.0, 1.0, 1.0) for i in range(90)] + [("short", i, 1.0, 1.0, 1.0) for i in range(30)] + [("gaps", i, 1.0, 1.0, None if i % 2 else 1.0) for i in range(60)]
    losses = spark.createDataFrame(rows, "panel_id string, target_period int, y_true double, y_a double, y_b double")
    assert {r.panel_id: r.least for r in E.selection_minimum(losses).collect()} == {"long": 40, "short": 15, "gaps": 15}
