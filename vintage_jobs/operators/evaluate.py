"""Backtest baselines, losses and error metrics. Forecast tables are long: panel_id, model_id, target_period, y_true, y_pred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage_jobs.functions.scalars import finite, no_nan
from vintage_jobs.operators.running import previous, running
from vintage_jobs.operators.vintage import asof_array, with_grid
from vintage_jobs.sources.store import stored


def expanding_ar1(targets: DataFrame, least: int = 10) -> DataFrame:
    """``y_pred``: the forecast of each target by least squares on all pairs (previous, own) before it.

    Running sums in two levels (see ``running``): linear in the history, and a long panel is many tasks. Sums are of what
    is left of the panel's mean. Where all previous values are the same c, the minimum-norm solution.
    """
    centre = targets.groupBy("panel_id").agg(F.coalesce(F.avg(no_nan(F.col("y"))), F.lit(0.0)).alias("__c"))
    rows = stored(previous(targets, ["panel_id"], "target_period", {"__x": "y"}).join(centre, "panel_id"), "pairs")
    pair = F.col("__x").isNotNull() & F.col("y").isNotNull()
    y, x = F.when(pair, F.col("y") - F.col("__c")), F.when(pair, F.col("__x") - F.col("__c"))
    sums = {"__n": F.when(pair, 1), "__sy": y, "__sx": x, "__sxy": x * y, "__sxx": x * x, "__i": F.lit(1)}
    extremes = {"__lo": ("min", F.when(pair, F.col("__x"))), "__hi": ("max", F.when(pair, F.col("__x")))}
    own = running(rows, ["panel_id"], "target_period", {name: ("sum", c) for name, c in sums.items()} | extremes)
    n, sx, sy, c = (F.col(v) for v in ("__n", "__sx", "__sy", "__lo"))
    slope = (n * F.col("__sxy") - sx * sy) / (n * F.col("__sxx") - sx * sx)
    fitted = F.col("__c") + sy / n + slope * (F.col("__x") - F.col("__c") - sx / n)
    flat = (F.col("__c") + sy / n) / (1 + c * c) * (1 + c * F.col("__x"))
    ready = (F.coalesce("__i", F.lit(0)) >= max(2, least)) & (n >= 1)
    return own.withColumn("y_pred", F.when(ready, F.when(F.col("__lo") == F.col("__hi"), flat).otherwise(fitted))).select(*targets.columns, "y_pred")


def expanding_mean(targets: DataFrame, least: int = 10) -> DataFrame:
    """``y_pred``: the mean of the targets before each one."""
    sums = {"__s": ("sum", F.col("y")), "__n": ("sum", F.when(F.col("y").isNotNull(), 1)), "__i": ("sum", F.lit(1))}
    own = running(targets, ["panel_id"], "target_period", sums)
    return own.withColumn("y_pred", F.when(F.col("__i") >= least, F.col("__s") / F.col("__n"))).select(*targets.columns, "y_pred")


def metrics(forecasts: DataFrame) -> DataFrame:
    """n, fmse, frmse, mae, fmse of the zero forecast and skill of each model, on finite pairs; null without one."""
    ok = finite(F.col("y_true")) & finite(F.col("y_pred"))
    e, y = F.when(ok, F.col("y_true") - F.col("y_pred")), F.when(ok, F.col("y_true"))
    own = forecasts.groupBy("panel_id", "model_id").agg(F.count(e).alias("n"), F.avg(e * e).alias("fmse"), F.avg(F.abs(e)).alias("mae"), F.avg(y * y).alias("fmse_zero"))
    return own.withColumns({"frmse": F.sqrt("fmse"), "skill": 1 - F.try_divide("fmse", "fmse_zero")})


def running_rmse(forecasts: DataFrame) -> DataFrame:
    """``rmse``: over all pairs up to each period; infinities count, NaN and null do not."""
    e = no_nan(F.col("y_true")) - no_nan(F.col("y_pred"))
    sums = {"__s": ("sum", e * e), "__n": ("sum", F.when(e.isNotNull(), 1))}
    own = running(forecasts, ["panel_id", "model_id"], "target_period", sums, inclusive=True)
    return own.withColumn("rmse", F.sqrt(F.col("__s") / F.col("__n"))).select(*forecasts.columns, "rmse")


def loss_differences(forecasts: DataFrame, model_a: str, model_b: str, loss: str = "squared") -> DataFrame:
    """panel_id, target_period, y_true, y_a, y_b, loss_diff: the loss of A less that of B, joined by date."""
    if loss not in ("squared", "absolute"):
        raise ValueError("loss must be squared or absolute")
    rows = forecasts.where(F.col("model_id").isin(model_a, model_b)).groupBy("panel_id", "target_period").agg(F.max("y_true").alias("y_true"), F.max(F.when(F.col("model_id") == model_a, F.col("y_pred"))).alias("y_a"), F.max(F.when(F.col("model_id") == model_b, F.col("y_pred"))).alias("y_b"))
    own = lambda c: (F.pow(F.col("y_true") - F.col(c), 2) if loss == "squared" else F.abs(F.col("y_true") - F.col(c)))
    return rows.withColumn("loss_diff", own("y_a") - own("y_b"))


def lag_design(losses: DataFrame, d: int) -> DataFrame:
    """``lag_1``.. ``lag_d`` of the non-null loss differences; rows without all of them are dropped."""
    w = Window.partitionBy("panel_id").orderBy("target_period")
    rows = losses.where(F.col("loss_diff").isNotNull()).withColumns({f"lag_{j}": F.lag("loss_diff", j).over(w) for j in range(1, d + 1)})
    return rows.where(F.col(f"lag_{d}").isNotNull())


def selection_minimum(losses: DataFrame) -> DataFrame:
    """panel_id, least: the losses a panel's selection begins after, min(40, max(5, n / 2)), of the n dates on which the
    truth and both forecasts are known."""
    n = F.count_if(F.col("y_true").isNotNull() & F.col("y_a").isNotNull() & F.col("y_b").isNotNull())
    return losses.groupBy("panel_id").agg(F.least(F.lit(40), F.greatest(F.lit(5), F.floor(n / 2))).cast("int").alias("least"))


def coverage(forecasts: DataFrame) -> DataFrame:
    """Non-missing forecasts and their first date by model, and the selection minimum min(40, max(5, n / 2))."""
    seen = F.col("y_pred").isNotNull() & F.col("y_true").isNotNull()
    own = forecasts.groupBy("panel_id", "model_id").agg(F.count_if(seen).alias("n"), F.min(F.when(seen, F.col("target_period"))).alias("first"))
    return own.withColumn("least", F.least(F.lit(40), F.greatest(F.lit(5), F.floor(F.col("n") / 2))).cast("long"))


def bounds(targets: DataFrame, method: str = "quantile", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """lo, hi of each panel's target: extremes or interpolated quantiles."""
    if method == "minmax":
        return targets.groupBy("panel_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    if method != "quantile":
        raise ValueError(f"unknown bounds: {method}")
    return targets.groupBy("panel_id").agg(F.percentile("y", F.lit(low)).alias("lo"), F.percentile("y", F.lit(high)).alias("hi"))


def bounds_in_time(targets: DataFrame, as_ofs: DataFrame, method: str = "minmax", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """panel_id, as_of, lo, hi: the extremes or quantiles of each panel's targets up to each as-of, so no clip looks ahead.

    A target goes to the first as-of at or after it; extremes then run over the as-ofs.
    """
    if method == "quantile":
        return quantiles_in_time(targets, as_ofs, low, high)
    if method != "minmax":
        raise ValueError(f"unknown bounds: {method}")
    grid = asof_array(as_ofs)
    first = F.array_min(F.filter("__grid", lambda d: d >= F.col("target_period")))
    seen = with_grid(targets, as_ofs).groupBy("panel_id", first.alias("as_of")).agg(F.min("y").alias("least"), F.max("y").alias("most"))
    every = targets.select("panel_id").distinct().withColumn("as_of", F.explode(grid)).join(seen, ["panel_id", "as_of"], "left")
    upto = Window.partitionBy("panel_id").orderBy("as_of")
    return every.select("panel_id", "as_of", F.min("least").over(upto).alias("lo"), F.max("most").over(upto).alias("hi"))


def quantiles_in_time(targets: DataFrame, as_ofs: DataFrame, low: float, high: float, buckets: int = 64) -> DataFrame:
    """panel_id, as_of, lo, hi: interpolated quantiles of each panel's targets up to each as-of, exact.

    Values are put into about equally full buckets of their panel. Counts of the buckets run over the as-ofs and tell in
    which bucket the two wanted ranks of a quantile lie, and at which rank there; only that bucket's values are then
    counted up to it. No step gathers a panel's values.
    """
    grid = asof_array(as_ofs)
    known = targets.where(F.col("y").isNotNull())
    first = F.array_min(F.filter("__grid", lambda d: d >= F.col("target_period")))
    values = with_grid(known, as_ofs).groupBy("panel_id", "y", first.alias("first")).agg(F.count("*").alias("n")).where("first IS NOT NULL")
    edges = known.groupBy("panel_id").agg(F.percentile_approx("y", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(10 * buckets)).alias("edges"))
    values = values.join(edges, "panel_id").withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("y")))).drop("edges")
    new = values.groupBy("panel_id", "bucket", F.col("first").alias("as_of")).agg(F.sum("n").alias("n"))
    every = values.select("panel_id", "bucket").distinct().withColumn("as_of", F.explode(grid)).join(new, ["panel_id", "bucket", "as_of"], "left")
    held = F.coalesce(F.sum("n").over(Window.partitionBy("panel_id", "bucket").orderBy("as_of")), F.lit(0))
    at = Window.partitionBy("panel_id", "as_of")
    every = every.withColumn("n", held).withColumns({"total": F.sum("n").over(at), "upto": F.sum("n").over(at.orderBy("bucket"))})

    def ranks(name: str, share: float) -> list[Column]:
        place = (F.col("total") - 1) * share
        return [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), whole(place).cast("long").alias("rank"), (place - F.floor(place)).alias("part")) for side, whole in ((0, F.floor), (1, F.ceil))]

    wanted = every.select("panel_id", "as_of", "bucket", "upto", "n", F.inline(F.array(*ranks("lo", low), *ranks("hi", high))))
    wanted = wanted.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("panel_id", "as_of", "bucket", "name", "side", "part", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    met = wanted.join(values.withColumnRenamed("n", "k"), ["panel_id", "bucket"]).where(F.col("first") <= F.col("as_of"))
    line = Window.partitionBy("panel_id", "as_of", "name", "side").orderBy("y", "first").rowsBetween(Window.unboundedPreceding, 0)
    found = met.withColumn("upto", F.sum("k").over(line)).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("k") <= F.col("rank")))
    share = F.when(F.col("side") == 0, 1 - F.col("part")).otherwise(F.col("part"))
    own = lambda name: F.sum(F.when(F.col("name") == name, F.col("y") * share))
    bounds_ = found.groupBy("panel_id", "as_of").agg(own("lo").alias("lo"), own("hi").alias("hi"))
    return targets.select("panel_id").distinct().withColumn("as_of", F.explode(grid)).join(bounds_, ["panel_id", "as_of"], "left")


def choice_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("panel_id", "choice").agg(F.count("*").alias("n"))
