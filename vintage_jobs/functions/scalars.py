"""Scalar expressions: cleaning, logs decided by series, rules, bounds, choices and kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the transformation rules.
RULE_CHANGE = "level (already change series)"
RULE_LEVEL = "level (ADF c stationary)"
RULE_DIFF = "diff (rate-like, ADF c nonstationary)"
RULE_LOG = "log-diff (ADF c nonstationary)"
RULE_TARGET = "quarterly log-diff (special)"


def unquoted(text: Column) -> Column:
    """Trimmed text without one pair of matching quotes around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"""^(["'])(.*)\1$""", "$2"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def safe_log(x: Column, any_negative: Column, any_zero: Column) -> Column:
    """Null for a series with a negative value, log1p for one with a zero, else ln."""
    return F.when(any_negative, None).when(any_zero, F.log1p(x)).otherwise(F.ln(x)).cast("double")


def transform_rule(series: Column, p_value: Column, is_target: Column, is_change: Column, is_rate: Column, alpha: float = 0.05) -> Column:
    """The rule of a series; a missing p-value is not stationary."""
    stationary = F.coalesce(p_value <= alpha, F.lit(False))
    return F.when(is_target, RULE_TARGET).when(is_change, RULE_CHANGE).when(stationary, RULE_LEVEL).when(is_rate, RULE_DIFF).otherwise(RULE_LOG)


def clipped(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def choice(mu: Column, tolerance: float = 1e-12) -> Column:
    """Which model a mean loss difference (A less B) favours."""
    return F.when(mu.isNull() | F.isnan(mu), "na").when(F.abs(mu) <= tolerance, "tie").when(mu < 0, "modelA").otherwise("modelB")


def chosen_value(choice_: Column, a: Column, b: Column) -> Column:
    """The favoured model's forecast; none for ties and where no choice was possible."""
    return F.when(choice_ == "modelA", a).when(choice_ == "modelB", b)


def failed_fit(ok: Column, converged: Column, error: Column) -> Column:
    """A fit failed with an error, without ok, or without convergence; missing flags count as good."""
    return error.isNotNull() | ~F.coalesce(ok, F.lit(True)) | ~F.coalesce(converged, F.lit(True))


def cache_key(model: Column, quarter: Column, day: Column) -> Column:
    return F.concat_ws("|", model, quarter, F.date_format(day, "yyyy-MM-dd"))


def vintage_name(as_of: Column) -> Column:
    return F.concat(F.lit("vintage_"), F.date_format(as_of, "yyyy-MM-dd"))


def epanechnikov(u: Column) -> Column:
    """One-sided kernel on [-1, 0]."""
    return F.when((u >= -1) & (u <= 0), 0.75 * (1 - u * u)).otherwise(0.0)
