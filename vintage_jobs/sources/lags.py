"""Release-lag metadata: cleaning a raw file and loading the lag of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage_jobs.functions.scalars import unquoted
from vintage_jobs.sources.panels import TARGET, table

SCHEDULE = {"release_day_in_month": "int", "release_week_in_month": "int", "release_weekday": "int", "release_dates": "string", "release_group": "string"}


def cleaned_lags(raw: DataFrame, target: str = TARGET, target_days: int = 45) -> DataFrame:
    """Renamed and trimmed rows with defaults; the target is quarterly with a fixed lag in days."""
    #: The column names of a raw lag file.
    named = raw.withColumnsRenamed({"Data_seminar": "series", "Lags_days": "lag_days", "Lags_weeks": "lag_weeks", "Lags_months": "lag_months"})
    own = named.select(F.trim("series").alias("series"), *(F.col(c).cast("int").alias(c) for c in ("lag_days", "lag_weeks", "lag_months"))).where((F.col("series") != "") & (F.lower("series") != "nan"))
    is_target = F.col("series") == target
    return own.select(
        "series",
        F.when(is_target, F.lit(target_days)).otherwise(F.col("lag_days")).alias("lag_days"),
        F.when(~is_target, F.col("lag_weeks")).alias("lag_weeks"),
        F.when(~is_target, F.col("lag_months")).alias("lag_months"),
        F.when(is_target, "Q").otherwise("M").alias("freq"),
        F.lit("period_end").alias("ref_point"),
    )


def release_lags(raw: DataFrame, order_col: str | None = None) -> DataFrame:
    """series_id, freq, ref_point, lag_unit, lag_value and schedule columns; days come before weeks before months.

    Series without a lag are left out, a negative lag is an error, and the last of repeated series wins: by ``order_col``,
    or without it by file name and place in the file.
    """
    for c, default in (("freq", "M"), ("ref_point", "period_end"), ("lag_days", None), ("lag_weeks", None), ("lag_months", None)):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(default))
    freq, ref = F.upper(F.trim("freq")), F.lower(F.trim("ref_point"))
    value = F.coalesce("lag_days", "lag_weeks", "lag_months").cast("int")
    unit = F.when(F.col("lag_days").isNotNull(), "days").when(F.col("lag_weeks").isNotNull(), "weeks").when(F.col("lag_months").isNotNull(), "months")
    rows = raw.select(
        unquoted(F.col("series")).alias("series_id"),
        F.when(freq == "TIMESTAMP", "timestamp").when(freq.isin("M", "Q"), freq).otherwise("M").alias("freq"),
        F.when(freq == "TIMESTAMP", "timestamp").when(ref.isin("period_end", "period_start", "timestamp"), ref).otherwise("period_end").alias("ref_point"),
        unit.alias("lag_unit"),
        value.alias("lag_value"),
        *(F.col(c).cast(t).alias(c) for c, t in SCHEDULE.items() if c in raw.columns),
        (F.col(order_col) if order_col else F.struct(F.input_file_name(), F.monotonically_increasing_id())).alias("file_order"),
    ).where((F.col("series_id") != "") & (F.lower("series_id") != "nan") & F.col("lag_unit").isNotNull())
    checked = rows.withColumn("lag_value", F.when(F.col("lag_value") >= 0, F.col("lag_value")).otherwise(F.raise_error(F.concat(F.lit("negative lag: "), "series_id")).cast("int")))
    rest = [c for c in checked.columns if c not in ("series_id", "file_order")]
    return checked.groupBy("series_id").agg(F.max_by(F.struct(*rest), "file_order").alias("s")).select("series_id", "s.*")


def nation_raw_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw lag file for the nation panel that takes every branch of the rules; the last series has no lag."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    nation = table(spark, sf_dir, "nation").select(
        key.cast("long").alias("file_order"),
        F.when(key % 5 == 0, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(F.lit(" "), name, F.lit(" "))).alias("series"),
        F.when((key % 3 == 0) & (key != 24), key % 4 * 7).alias("lag_days"),
        F.when((key % 3 <= 1) & (key != 24), key % 4).alias("lag_weeks"),
        F.when(key != 24, key % 4).alias("lag_months"),
        F.when(key == 2, " timestamp").when(key == 3, "q").when(key == 4, "weird").otherwise("M").alias("freq"),
        F.when(key == 1, "Period_Start").when(key == 5, "bad").otherwise("period_end").alias("ref_point"),
    )
    target = spark.range(1).select(F.lit(1000).cast("long").alias("file_order"), F.lit(TARGET).alias("series"), F.lit(45).alias("lag_days"), F.lit(None).cast("int").alias("lag_weeks"), F.lit(None).cast("int").alias("lag_months"), F.lit("Q").alias("freq"), F.lit("period_end").alias("ref_point"))
    return nation.unionByName(target)
