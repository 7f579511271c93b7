"""Panels: reading, regular grids, and the panels of the order tables.

A panel is long: panel_id, series_id, period (date), value (double, null where missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "TOTAL"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coerced_panel(wide: DataFrame, series: list[str], date_col: str = "date", panel_id: str = "panel_id") -> DataFrame:
    """A wide table of texts as a long panel: unreadable dates drop the row, unreadable numbers and NaN become null."""
    period = F.coalesce(F.try_to_timestamp(F.col(date_col)), F.try_to_timestamp(F.col(date_col), F.lit("dd/MM/yyyy"))).cast("date")
    rows = wide.withColumn("period", period).where(F.col("period").isNotNull())
    long = rows.select(panel_id, "period", *(F.col(s).cast("string").alias(s) for s in series)).unpivot([panel_id, "period"], series, "series_id", "text")
    number = F.col("text").try_cast("double")
    return long.select(F.col(panel_id).alias("panel_id"), "series_id", "period", F.when(~F.isnan(number), number).alias("value"))


def read_csv_panel(spark: SparkSession, path: str, date_col: str = "date") -> DataFrame:
    """A wide CSV file with a date column as a long panel with one panel_id."""
    wide = spark.read.option("header", True).csv(path)
    if date_col not in wide.columns:
        raise ValueError(f"the file needs a column {date_col}")
    return coerced_panel(wide.withColumn("panel_id", F.lit("0")), [c for c in wide.columns if c != date_col], date_col)


def wide_panel(panel: DataFrame, series: list[str]) -> DataFrame:
    """One column a series, for sinks; the series are given, so no extra pass finds them."""
    return panel.groupBy("panel_id", "period").pivot("series_id", series).agg(F.first("value", ignorenulls=True))


def monthly_grid(panel: DataFrame) -> DataFrame:
    """Every series of a panel on all month starts from the panel's first to its last; dates off the grid are dropped.

    Of repeated rows of a series and period the greatest value stays.
    """
    on_grid = panel.where(F.col("period") == F.trunc("period", "MM"))
    span = panel.groupBy("panel_id").agg(F.add_months(F.trunc(F.date_sub(F.min("period"), 1), "MM"), 1).alias("first"), F.trunc(F.max("period"), "MM").alias("last"))
    months = F.when(F.col("first") <= F.col("last"), F.sequence("first", "last", F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    grid = panel.select("panel_id", "series_id").distinct().join(span, "panel_id").select("panel_id", "series_id", F.explode(months).alias("period"))
    return grid.join(on_grid.groupBy("panel_id", "series_id", "period").agg(F.max("value").alias("value")), ["panel_id", "series_id", "period"], "left")


def write_panel(panel: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a long or wide panel in the order of panel, period and, where there is one, series."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    order = [c for c in ("panel_id", "period", "series_id") if c in panel.columns]
    panel.orderBy(*order).write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_vintages(vintages: DataFrame, path: str, fmt: str = "parquet", salts: int = 8) -> None:
    """One folder an as-of; only the as-ofs that are there are replaced. Rows of an as-of are spread over ``salts`` files."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    spread = vintages.repartition("as_of", F.pmod(F.xxhash64("panel_id", "series_id"), F.lit(salts))).sortWithinPartitions("as_of", "panel_id", "series_id", "period")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("as_of").format(fmt).save(path)


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by nation; the panel is the region."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    keys = [F.col("n_regionkey").cast("string").alias("panel_id"), F.col("n_name").alias("series_id"), F.trunc("o_orderdate", "MM").cast("date").alias("period")]
    return joined.groupBy(*keys).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def with_target(panel: DataFrame, target: str = TARGET) -> DataFrame:
    """Adds the quarterly total of each panel, in the last month of the quarter."""
    month = F.add_months(F.trunc("period", "quarter"), 2)
    total = panel.groupBy("panel_id", month.alias("period")).agg(F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("value"))
    return panel.unionByName(total.select("panel_id", F.lit(target).alias("series_id"), "period", "value"))


def monthly_target(panel: DataFrame) -> DataFrame:
    """panel_id, target_period, y: the monthly total of each panel."""
    return panel.groupBy("panel_id", F.col("period").alias("target_period")).agg(F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("y"))
