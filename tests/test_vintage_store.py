"""Stored intervals against vintages made one by one."""

import os

import pytest
from pyspark.sql import functions as F

from vintage_jobs.jobs import fixtures as X
from vintage_jobs.operators import vintage as V
from vintage_jobs.sources import vintage_store as K
from vintage_jobs.sources.store import shared_dir

RELEASE = "panel_id string, series_id string, period date, value double, available_at string"


def releases(spark, rows):
    made = spark.createDataFrame([("p", s, p, v, a) for s, p, v, a in rows], "panel_id string, series_id string, period string, value double, available_at string")
    return made.withColumns({"period": F.to_date("period"), "available_at": F.col("available_at").cast("timestamp_ntz")})


def plain(rows, limit):
    """The value of each cell at an instant: of its latest release."""
    out = {}
    for s, p, v, a in sorted(rows, key=lambda r: (r[3] or "", r[2] is not None, r[2] or 0)):
        if (a or "") <= limit:
            out[s, p] = v
    return out


ROWS = [
    ("a", "2000-01-01", 1.0, "2000-02-10 00:00:00"), ("a", "2000-01-01", 2.0, "2000-03-10 00:00:00"), ("a", "2000-01-01", 2.0, "2000-04-10 00:00:00"), ("a", "2000-01-01", None, "2000-05-10 00:00:00"),
    ("a", "2000-02-01", 5.0, "2000-03-31 12:00:00"), ("b", "2000-01-01", None, "2000-01-31 00:00:00"), ("b", "2000-01-01", 7.0, "2000-06-01 00:00:00"), ("b", "2000-02-01", 3.0, "2000-02-29 00:00:00"), ("b", "2000-02-01", 4.0, "2000-02-29 00:00:00"), ("c", "2000-01-01", 9.0, None),
]
DAYS = ["1999-12-31", "2000-01-31", "2000-02-10", "2000-02-29", "2000-03-31", "2000-04-30", "2000-05-10", "2000-06-30"]


@pytest.fixture(scope="module")
def store(spark):
    path = f"{shared_dir(spark)}/store-test"
    K.write_store(releases(spark, ROWS), path)
    return K.read_store(spark, path)


@pytest.mark.parametrize("inclusive", [False, True])
def test_revised_cells_at_each_day(spark, store, inclusive):
    for day in DAYS:
        want = plain(ROWS, f"{day} 23:59:59" if inclusive else f"{day} 00:00:00")
        got = {(r.series_id, str(r.period)): r.value for r in K.vintage_at(store, day, inclusive).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}, day
        dense = [((r.series_id, str(r.period)), r.value) for r in K.vintage_at(store, day, inclusive, dense=True).collect()]
        assert sorted(dense, key=str) == sorted(({(s, p): None for s, p, _, _ in ROWS} | want).items(), key=str), day
    as_ofs = spark.createDataFrame([(d,) for d in DAYS], "d string").select(F.to_date("d").alias("as_of"))
    many = {(str(r.as_of), r.series_id, str(r.period)): r.value for r in K.vintages_from(store, as_ofs, inclusive).collect()}
    assert many == {(d, *k): v for d in DAYS for k, v in plain(ROWS, f"{d} 23:59:59" if inclusive else f"{d} 00:00:00").items() if v is not None}


def test_manifest_of_revised_cells(spark, store):
    as_ofs = spark.createDataFrame([(d,) for d in DAYS], "d string").select(F.to_date("d").alias("as_of"))
    got = {str(r.as_of): r for r in K.manifest_from(store, as_ofs).collect()}
    for d in DAYS:
        seen = sum(v is not None for v in plain(ROWS, f"{d} 00:00:00").values())
        assert (got[d].n_rows, got[d].n_cols, got[d].n_cells) == (2, 3, 5) and got[d].na_share == pytest.approx(1 - seen / 5)


def test_intervals_do_not_overlap_and_repeat_no_value(store):
    rows = sorted((r.series_id, r.period, r.known_from, r.known_to, r.value) for r in store.collect())
    for a, b in zip(rows, rows[1:], strict=False):
        if a[:2] == b[:2]:
            assert a[3] == b[2] and a[4] != b[4]
    assert len(rows) == 8


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_bytes_do_not_grow_with_as_ofs_and_later_folders_stay_closed(spark, small_dir):
    panel, lags = X.panel(spark, small_dir), X.lags(spark, small_dir)
    path = f"{shared_dir(spark)}/store-size"
    K.write_store(V.with_availability(panel, lags), path)
    found = K.read_store(spark, path)
    assert found.count() == panel.count()
    twice = f"{shared_dir(spark)}/store-size-twice"
    again = panel.withColumn("panel_id", F.concat("panel_id", F.lit("x")))
    K.write_store(V.with_availability(panel.unionByName(again), lags), twice)
    assert size(twice) < 2.2 * size(path)
    early = K.vintage_at(found, "1996-06-30")
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(value)" in plan.replace("IsNotNull(known_from), ", "")
    opened = {f.split("from_month=")[1][:7] for f in early.inputFiles()}
    read = early.select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all(r.f.split("from_month=")[1][:7] <= "1996-06" for r in read) and len(opened) > 0
    whole = V.published(panel, lags, spark.createDataFrame([("1996-06-30",)], "d string").select(F.to_date("d").alias("as_of")))
    assert sorted(map(str, early.collect())) == sorted(map(str, whole.drop("as_of").collect()))
