"""Running aggregates in two levels, so that one long group is many tasks.

A group's rows are cut into blocks of its dates (a year each by default: at most 366 different dates). Aggregates run
within a block by a window, the blocks' totals run over the few blocks of a group, and both are joined on the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _blocks(rows: DataFrame, at: str, block: Column | None) -> DataFrame:
    return rows.withColumn("__block", F.year(at) if block is None else block)


def running(rows: DataFrame, keys: list[str], at: str, wanted: dict[str, tuple[str, Column]], inclusive: bool = False, block: Column | None = None) -> DataFrame:
    """Adds, for each name, the sum, min or max (kind, column) of the group's rows before each row, by ``at``.

    With ``inclusive`` the row itself counts too. Null without a value so far. Keys are not null.
    """
    own = _blocks(rows, at, block)
    by = Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys, "__block").agg(*(_KINDS[k](c).alias(f"__t_{n}") for n, (k, c) in wanted.items()))
    totals = totals.select(*keys, "__block", *(_KINDS[k](f"__t_{n}").over(before).alias(f"__b_{n}") for n, (k, _) in wanted.items()))
    inner = own.withColumns({f"__w_{n}": _KINDS[k](c).over(by) for n, (k, c) in wanted.items()}).join(totals, [*keys, "__block"])

    def both(n: str, kind: str) -> Column:
        w, b = F.col(f"__w_{n}"), F.col(f"__b_{n}")
        return F.coalesce(w + b, w, b) if kind == "sum" else F.least(w, b) if kind == "min" else F.greatest(w, b)

    return inner.select(*rows.columns, *(both(n, k).alias(n) for n, (k, _) in wanted.items()))


def previous(rows: DataFrame, keys: list[str], at: str, wanted: dict[str, str], block: Column | None = None) -> DataFrame:
    """Adds, for each name, the column's value in the group's row before; the last of a block is handed to the next one."""
    own = _blocks(rows, at, block)
    ends = own.groupBy(*keys, "__block").agg(F.max_by(F.struct(*(F.col(c).alias(n) for n, c in wanted.items())), at).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__block")))
    by = Window.partitionBy(*keys, "__block").orderBy(at)
    inner = own.withColumns({"__first": F.row_number().over(by) == 1, **{f"__l_{n}": F.lag(c).over(by) for n, c in wanted.items()}}).join(ends, [*keys, "__block"])
    return inner.select(*rows.columns, *(F.when(F.col("__first"), F.col(f"__end.{n}")).otherwise(F.col(f"__l_{n}")).alias(n) for n in wanted))
