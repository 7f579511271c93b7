"""Vintages: what was known of a panel on a date, given the publication lag of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage_jobs.functions import dates as D

DEFAULT_LAG = {"freq": "M", "ref_point": "period_end", "lag_unit": "months", "lag_value": 0}


def asof_grid(span: DataFrame) -> DataFrame:
    """as_of: the month ends within a span (start, end). As many rows as months, so it may be broadcast."""
    return span.select(F.explode(D.month_end_grid(F.col("start"), F.col("end"))).alias("as_of"))


def panel_span(panel: DataFrame, lead: int = 0) -> DataFrame:
    """start, end: one row, from the month of the first period of all panels to the end of the month ``lead`` after the last."""
    ends = panel.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    return ends.select(D.month_start(F.col("lo")).alias("start"), F.last_day(F.add_months("hi", lead)).alias("end"))


def fixed_span(spark: SparkSession, start: str, end: str) -> DataFrame:
    """start, end: one row with two given days."""
    return spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))


def panel_asofs(panel: DataFrame, months: int) -> DataFrame:
    """panel_id, as_of: the month ends of each panel from its month number ``months`` to its last."""
    spans = panel.groupBy("panel_id").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    start, end = F.add_months(D.month_start(F.col("lo")), months - 1), F.last_day("hi")
    return spans.where(start <= end).select("panel_id", F.explode(D.month_end_grid(start, end)).alias("as_of"))


def asof_array(as_ofs: DataFrame) -> Column:
    """All as-ofs in order, as one value: a scalar subquery, so that nothing is joined with them."""
    return as_ofs.agg(F.sort_array(F.collect_set("as_of")).alias("grid")).scalar()


def with_grid(rows: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """``rows`` with all as-ofs in order in the column __grid, for functions over arrays."""
    return rows.withColumn("__grid", asof_array(as_ofs))


def first_asof(instant: Column, grid: Column) -> Column:
    """The first as-of of a sorted grid that shows what came out at ``instant``; null without one."""
    return F.array_min(F.filter(grid, lambda d: D.ntz(d) >= instant))


def with_lags(panel: DataFrame, lags: DataFrame, default: dict = DEFAULT_LAG) -> DataFrame:
    """The panel with the lag columns of its series; unlisted series get the default."""
    joined = panel.join(lags.select("series_id", *default), "series_id", "left")
    return joined.select(*panel.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in default.items()))


def with_availability(panel: DataFrame, lags: DataFrame, default: dict = DEFAULT_LAG) -> DataFrame:
    """The panel with ``available_at``, the instant each observation is published."""
    own = with_lags(panel, lags, default)
    at = D.available_at(D.reference_time(F.col("period"), F.col("freq"), F.col("ref_point")), F.col("lag_unit"), F.col("lag_value"))
    return own.select(*panel.columns, at.alias("available_at"))


def visible(as_of: Column, inclusive_day: bool = False) -> Column:
    """Whether an observation is out at midnight of the as-of day, or at its end."""
    limit = D.ntz(F.date_add(as_of, 1)) if inclusive_day else D.ntz(as_of)
    return F.col("available_at") < limit if inclusive_day else F.col("available_at") <= limit


def vintages(panel: DataFrame, lags: DataFrame, as_ofs: DataFrame, inclusive_day: bool = False) -> DataFrame:
    """The panel once for each as-of, with unpublished cells nulled. For one as-of a filter on available_at does."""
    own = with_availability(panel, lags).crossJoin(F.broadcast(as_ofs))
    return own.select("as_of", "panel_id", "series_id", "period", F.when(visible(F.col("as_of"), inclusive_day), F.col("value")).alias("value"))


def published(panel: DataFrame, lags: DataFrame, as_ofs: DataFrame, inclusive_day: bool = False) -> DataFrame:
    """Only the published, non-null cells of each as-of."""
    own = with_availability(panel.where(F.col("value").isNotNull()), lags)
    return own.join(F.broadcast(as_ofs), visible(F.col("as_of"), inclusive_day)).select("as_of", "panel_id", "series_id", "period", "value")


def truncated_vintages(panel: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """Vintages without lags: cells after the as-of are nulled, all rows stay."""
    return panel.crossJoin(F.broadcast(as_ofs)).select("as_of", "panel_id", "series_id", "period", F.when(F.col("period") <= F.col("as_of"), F.col("value")).alias("value"))


def month_lag_vintages(panel: DataFrame, lag_months: DataFrame, as_ofs: DataFrame, default: int = 0) -> DataFrame:
    """Vintages with lags in whole months: rows up to the as-of, cells nulled where later than its month less the lag."""
    own = panel.join(lag_months.select("series_id", "lag"), "series_id", "left").join(F.broadcast(as_ofs), F.col("period") <= F.col("as_of"))
    edge = F.add_months(D.month_start(F.col("as_of")), -F.coalesce("lag", F.lit(default)))
    return own.select("as_of", "panel_id", "series_id", "period", F.when(F.col("period") <= edge, F.col("value")).alias("value"))


def manifest(panel: DataFrame, lags: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """as_of, panel_id, file, n_rows, n_cols, na_share of each vintage without making any of them.

    Each non-null cell goes to the first as-of that shows it; visible cells are running counts over the as-ofs.
    """
    size = panel.groupBy("panel_id").agg(F.count_distinct("period").alias("n_rows"), F.count_distinct("series_id").alias("n_cols"))
    grid = asof_array(as_ofs)
    cells = with_availability(panel.where(F.col("value").isNotNull()), lags).groupBy("panel_id", "available_at").agg(F.count("*").alias("n"))
    new = with_grid(cells, as_ofs).groupBy("panel_id", first_asof(F.col("available_at"), F.col("__grid")).alias("as_of")).agg(F.sum("n").alias("n")).where(F.col("as_of").isNotNull())
    every = size.withColumn("as_of", F.explode(grid)).join(new, ["panel_id", "as_of"], "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("panel_id").orderBy("as_of"))
    share = 1 - running / (F.col("n_rows") * F.col("n_cols"))
    from vintage_jobs.functions.scalars import vintage_name

    return every.select("as_of", "panel_id", vintage_name(F.col("as_of")).alias("file"), "n_rows", "n_cols", share.alias("na_share"))


def training_sample(panel: DataFrame, as_ofs: DataFrame, start: str) -> DataFrame:
    """Expanding samples: the rows from ``start`` to each as-of."""
    return panel.where(F.col("period") >= F.lit(start).cast("date")).join(F.broadcast(as_ofs), F.col("period") <= F.col("as_of"))


def target_quarters(panel: DataFrame, lags: DataFrame, as_ofs: DataFrame, target: str, ahead: int = 8) -> DataFrame:
    """as_of, panel_id, quarter: the first quarter whose target is not yet published.

    Candidates run from the panel's first quarter to ``ahead`` after its last; if all are out, the one after them.
    """
    quarterly = F.when(F.col("freq") == "Q", F.col("freq")).otherwise(F.raise_error(F.lit("the target must be quarterly")).cast("string"))
    meta = lags.where(F.col("series_id") == target).select(F.struct(quarterly.alias("freq"), "ref_point", "lag_unit", "lag_value").alias("m")).scalar()
    span = panel.groupBy("panel_id").agg(D.quarter_start(F.min("period")).alias("lo"), F.add_months(D.quarter_start(F.max("period")), 3 * ahead).alias("hi")).withColumn("m", meta).where("m IS NOT NULL")
    quarters = span.select("panel_id", "m", "hi", F.explode(F.sequence("lo", "hi", F.expr("interval 3 month"))).alias("q"))
    out = D.available_at(D.reference_time(F.col("q"), F.col("m.freq"), F.col("m.ref_point")), F.col("m.lag_unit"), F.col("m.lag_value"))
    none = F.lit(None).cast("date")
    candidates = quarters.select("panel_id", "hi", "q", out.alias("at"), none.alias("as_of"))
    asked = span.select("panel_id", "hi", none.alias("q"), F.explode(asof_array(as_ofs)).alias("as_of")).select("panel_id", "hi", "q", D.ntz(F.col("as_of")).alias("at"), "as_of")
    # in one line of time, an as-of looks ahead to what comes out after it
    ahead_of = Window.partitionBy("panel_id").orderBy("at", F.col("as_of").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    found = candidates.unionByName(asked).withColumn("quarter", F.min("q").over(ahead_of)).where(F.col("as_of").isNotNull())
    return found.select("as_of", "panel_id", F.coalesce("quarter", F.add_months("hi", 3)).alias("quarter"))


def target_phase(panel: DataFrame, target: str) -> DataFrame:
    """panel_id, phase: the most frequent month number modulo three of the target; ties go to the one seen first."""
    seen = panel.where((F.col("series_id") == target) & F.col("value").isNotNull())
    counts = seen.groupBy("panel_id", F.pmod(F.month("period"), F.lit(3)).alias("phase")).agg(F.count("*").alias("n"), F.min("period").alias("first"))
    return counts.groupBy("panel_id").agg(F.max_by("phase", F.struct("n", -F.unix_date("first"))).alias("phase"))


def quarter_months_only(panel: DataFrame, target: str) -> DataFrame:
    """The panel with the target nulled outside its quarter months."""
    own = panel.join(target_phase(panel, target), "panel_id", "left")
    keep = (F.col("series_id") != target) | (F.pmod(F.month("period"), F.lit(3)) == F.col("phase"))
    return own.select("panel_id", "series_id", "period", F.when(keep, F.col("value")).alias("value"))


def vintage_moments(panel: DataFrame, lags: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """panel_id, series_id, as_of, n, mean, sd (ddof 0) of the visible values of each series at each as-of.

    Each value goes to the first as-of that shows it; moments of these groups (count, mean, squared deviations, extremes)
    are merged over the as-ofs. So the work is linear in the cells, and no vintage is made.
    """
    series, grid = ["panel_id", "series_id"], asof_array(as_ofs)
    cells = with_grid(with_availability(panel.where(F.col("value").isNotNull()), lags), as_ofs)
    own = cells.select(*series, first_asof(F.col("available_at"), F.col("__grid")).alias("as_of"), "value").where("as_of IS NOT NULL")
    parts = own.groupBy(*series, "as_of").agg(F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    every = panel.select(*series).distinct().withColumn("as_of", F.explode(grid)).join(parts, [*series, "as_of"], "left")
    whole = Window.partitionBy(*series)
    upto = whole.orderBy("as_of")
    every = every.withColumn("c", F.sum(F.col("k") * F.col("m")).over(whole) / F.sum("k").over(whole))  # sums are of what is left of it
    off = F.col("m") - F.col("c")
    sums = {"n": F.col("k"), "s": F.col("k") * off, "q": F.col("k") * (off * off + F.col("v"))}
    every = every.withColumns({name: F.sum(x).over(upto) for name, x in sums.items()} | {"lo": F.min("lo").over(upto), "hi": F.max("hi").over(upto)})
    same, shift = F.col("lo") == F.col("hi"), F.col("s") / F.col("n")
    sd = F.when(same, 0.0).when(F.col("n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - shift * shift)))
    return every.select(*series, "as_of", F.coalesce("n", F.lit(0)).alias("n"), F.when(same, F.col("lo")).otherwise(F.col("c") + shift).alias("mean"), sd.alias("sd"))


def standardised_from(vintage: DataFrame, moments: DataFrame) -> DataFrame:
    """``z``: each value of a vintage less its series' mean at the as-of, over its deviation (one where that is zero)."""
    own = vintage.join(moments, ["panel_id", "series_id", "as_of"])
    return own.select(*vintage.columns, ((F.col("value") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z"))


def standardised_vintages(vintage: DataFrame) -> DataFrame:
    """Each series of each vintage less its mean, over its deviation (ddof 0; one where that is zero)."""
    by = Window.partitionBy("as_of", "panel_id", "series_id")
    sd = F.stddev_pop("value").over(by)
    return vintage.withColumn("z", (F.col("value") - F.avg("value").over(by)) / F.when(sd == 0, 1.0).otherwise(sd))
