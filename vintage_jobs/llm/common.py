"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_let_go: list[Callable[[], None]] = []


def keeps(release: Callable[[], None]) -> None:
    """Registers what lets go of a thing that a worker keeps between its tasks."""
    _let_go.append(release)


def start_bare() -> None:
    """Called where a step of another kind begins in a worker: Spark gives workers from step to step, and what earlier steps
    keep in them (tokenizers, encoded words) would stay in memory beside it."""
    for release in _let_go:
        release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read with Spark so that any store that Spark reaches works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one beside the warehouse on one machine, and
    an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        warnings.warn(f"spark.checkpoint.dir is unset; intermediate tables go to {found}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within_bound(sizes: Iterable[tuple], bound: int) -> list:
    """The keys of (key, size) that together stay within ``bound``, in the given order.

    One that does not fit is skipped and ends nothing. None has over a tenth of the bound, unless all have: then the
    smallest come first.
    """
    sizes = list(sizes)
    fair = [s for s in sizes if 10 * s[1] <= bound] or sorted(sizes, key=lambda s: s[1])
    kept, total = [], 0
    for key, size in fair:
        if total + size <= bound:
            kept.append(key)
            total += size
    return kept


def row_mapper(names: list[str], arrow: pa.Schema, each: Callable) -> Callable:
    """A mapInArrow function that applies ``each(*values) -> tuple`` to every row and keeps nothing between batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [each(*r) for r in zip(*(part.column(n).to_pylist() for n in names), strict=True)]
                columns = list(zip(*rows, strict=True)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return work


def crc32_of(column: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def widest(spark: SparkSession, least: int = 8) -> int:
    """How many partitions a shuffle of this session has."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fair_share(spark: SparkSession, total: int) -> int:
    """How many of ``total`` rows may share a key and stay in one task: half a task's share."""
    return max(64, total // (2 * widest(spark)))


def joined_by_key(rows: DataFrame, of: DataFrame, key: str, size: str, total: int, apart: list[str | Column]) -> DataFrame:
    """``rows`` joined with ``of`` (one row a key; column ``size``: about how many of the ``total`` rows have that key).

    Keys with more than 1 / (2 partitions) of the rows are dealt over several tasks by a hash of the columns ``apart``.
    There are fewer than 2 partitions such keys, so their table is broadcast whatever the input is.
    """
    limit = fair_share(rows.sparkSession, total)
    hot = of.where(F.col(size) > limit).select(key, F.ceil(F.col(size) / limit).cast("int").alias("__ways"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__way", F.pmod(F.xxhash64(*apart), F.coalesce("__ways", F.lit(1))).cast("int")).drop("__ways")
    ways = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit).cast("int")).otherwise(F.lit(1))
    right = of.withColumn("__way", F.explode(F.sequence(F.lit(0), ways - 1)))
    return left.join(right, [key, "__way"]).drop("__way")
