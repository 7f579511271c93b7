"""Stored vintages as intervals: one row for each value a cell ever had, with the time it was current.

A vintage is what a reader finds at an as-of, for any as-of, not only those of a grid; the bytes on disk are linear in
the values, however many as-ofs are read. Files lie in folders by the month a value came out, sorted by that instant, so
a reader opens no folder that is newer than its as-of, and skips what was replaced before it by the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage_jobs.functions.dates import month_start, ntz
from vintage_jobs.operators.vintage import asof_array, first_asof, with_grid

CELL = ["panel_id", "series_id", "period"]
SCHEMA = "panel_id string, series_id string, period date, value double, known_from timestamp_ntz, known_to timestamp_ntz, is_first boolean, from_month date"


def intervals(releases: DataFrame) -> DataFrame:
    """Releases (cell, value, available_at) as intervals: each is current until the cell's next one.

    Of releases of one cell at one instant the greatest value counts (null is the least). One that repeats the value before
    it opens no interval of its own. A cell without any release instant is known from the start.
    """
    at = F.coalesce("available_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    rows = releases.groupBy(*CELL, at.alias("known_from")).agg(F.max("value").alias("value"))
    line = Window.partitionBy(*CELL).orderBy("known_from")
    before, first = F.lag("value").over(line), F.row_number().over(line) == 1
    changed = rows.withColumns({"is_first": first, "same": ~first & F.col("value").eqNullSafe(before)}).where("NOT same")
    return changed.select(*CELL, "value", "known_from", F.lead("known_from").over(line).alias("known_to"), "is_first")


def write_store(releases: DataFrame, path: str, salts: int = 8) -> None:
    """Writes the intervals; a month's rows are spread over ``salts`` files."""
    rows = intervals(releases).withColumn("from_month", month_start(F.col("known_from")))
    spread = rows.repartition("from_month", F.pmod(F.xxhash64("panel_id", "series_id"), F.lit(salts))).sortWithinPartitions("from_month", "known_from", "panel_id", "series_id", "period")
    spread.write.mode("overwrite").partitionBy("from_month").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _limit(as_of: Column, inclusive_day: bool) -> Column:
    """The instant up to which releases count: midnight of the as-of day, or the last microsecond of it."""
    return ntz(F.date_add(as_of, 1)) - F.expr("INTERVAL '0.000001' SECOND") if inclusive_day else ntz(as_of)


def current(as_of: Column, inclusive_day: bool = False) -> Column:
    """Whether an interval holds at the as-of."""
    limit = _limit(as_of, inclusive_day)
    return (F.col("known_from") <= limit) & (F.col("known_to").isNull() | (F.col("known_to") > limit))


def vintage_at(store: DataFrame, as_of: str, inclusive_day: bool = False, dense: bool = False) -> DataFrame:
    """panel_id, series_id, period, value at one as-of (yyyy-mm-dd): the published non-null cells, or with ``dense`` all
    cells the store ever has, null where not yet published. Only the former leaves folders unread."""
    day = F.lit(as_of).cast("date")
    held = current(day, inclusive_day)
    if not dense:
        pruned = store.where((F.col("from_month") <= month_start(day)) & F.col("value").isNotNull())
        return pruned.where(held).select(*CELL, "value")
    waiting = F.col("is_first") & (F.col("known_from") > _limit(day, inclusive_day))
    return store.where(held | waiting).select(*CELL, F.when(held, F.col("value")).alias("value"))


def vintages_from(store: DataFrame, as_ofs: DataFrame, inclusive_day: bool = False) -> DataFrame:
    """as_of and the published cells of each as-of: an interval is expanded to the as-ofs it holds at, and to no others."""
    limit = lambda d: _limit(d, inclusive_day)
    held = F.filter("__grid", lambda d: (F.col("known_from") <= limit(d)) & (F.col("known_to").isNull() | (F.col("known_to") > limit(d))))
    return with_grid(store.where(F.col("value").isNotNull()), as_ofs).select(F.explode(held).alias("as_of"), *CELL, "value")


def manifest_from(store: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """as_of, panel_id, n_rows, n_cols, n_cells, na_share of each vintage: a value counts from the first as-of that shows
    it to the first that no longer does, and counts run over the as-ofs. No vintage is made."""
    size = store.groupBy("panel_id").agg(F.count_distinct("period").alias("n_rows"), F.count_distinct("series_id").alias("n_cols"), F.count_if("is_first").alias("n_cells"))
    grid = F.col("__grid")
    steps = F.array(F.struct(first_asof(F.col("known_from"), grid).alias("as_of"), F.lit(1).alias("n")), F.struct(first_asof(F.col("known_to"), grid).alias("as_of"), F.lit(-1).alias("n")))
    new = with_grid(store.where(F.col("value").isNotNull()), as_ofs).select("panel_id", F.inline(steps)).where("as_of IS NOT NULL").groupBy("panel_id", "as_of").agg(F.sum("n").alias("n"))
    every = size.withColumn("as_of", F.explode(asof_array(as_ofs))).join(new, ["panel_id", "as_of"], "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("panel_id").orderBy("as_of"))
    return every.select("as_of", "panel_id", "n_rows", "n_cols", "n_cells", (1 - running / F.col("n_cells")).alias("na_share"))
