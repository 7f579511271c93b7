"""Every registered core query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from vintage_jobs.jobs.registry import CORE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small_dir):
    own = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{small_dir}/{name}.parquet"):
            own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    return own


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(table, columns):
    return sorted(str([plain(r[c]) for c in columns]) for r in table.to_pylist())


@pytest.mark.parametrize("name", [n for n, q in CORE.items() if q.sql])
def test_against_sql(spark, duck, small_dir, name):
    got = CORE[name].query(spark, small_dir)
    columns = sorted(got.columns)
    want = duck.execute(CORE[name].sql).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert rows(got.toArrow(), columns) == rows(want, columns)


@pytest.mark.parametrize("name", [n for n, q in CORE.items() if not q.sql and n not in ("x5_factor_mixture", "x6_factor_backtest", "wl3_mixture_over_time", "wl3_evaluation")])
def test_fits_give_rows(spark, small_dir, name):
    assert CORE[name].query(spark, small_dir).count() > 0


def test_evaluation_selects_between_trees_and_mixture(spark, small_dir):
    rows = CORE["wl3_evaluation"].query(spark, small_dir).collect()
    assert {(r.grid, r.model_id) for r in rows} >= {(g, m) for g in ("quarter", "month") for m in ("tree", "ar1", "dfm", "selected")}
    assert sum(r.n for r in rows if r.grid == "month" and r.model_id == "selected") > 0


def test_flagship(spark, small_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
