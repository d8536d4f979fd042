"""Exact row numbers and running totals over a whole table or within very large groups.

A window without PARTITION BY, or one whose partition holds a large share of the table, is
sorted by a single task. Here the rows are range-partitioned on the full sort key, written,
numbered inside each range, and shifted by the totals of the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialise

# a range should keep one task busy, and must not outgrow it
MIN_ROWS_PER_RANGE = 2_000
MAX_ROWS_PER_RANGE = 1_000_000


def range_count(df: DataFrame, rows: int) -> int:
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return max(min(parallel, rows // MIN_ROWS_PER_RANGE), math.ceil(rows / MAX_ROWS_PER_RANGE), 1)


def with_running(
    df: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    rank: str = "row_rank",
    total: str | None = None,
    running: str = "running_total",
    ranges: int | None = None,
) -> DataFrame:
    """Add ``rank`` and, for a ``total`` column, its ``running`` sum in the given order.

    ``order`` must end in a unique column and be explicit about NULLs. With ``within``, both
    restart for each group; a group may span any number of ranges.
    """
    groups = list(within)
    if ranges is None:
        ranges = range_count(df, df.count())
    sort = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    ranged = df.repartitionByRange(ranges, *sort).withColumn("_range", F.spark_partition_id())
    staged = materialise(ranged, "ranged")

    in_range = Window.partitionBy("_range", *groups).orderBy(*order)
    numbered = staged.withColumn(rank, F.row_number().over(in_range).cast("bigint"))
    measures = {"_rows": F.count("*")}
    if total:
        until_here = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = numbered.withColumn(running, F.sum(F.coalesce(F.col(total), F.lit(0))).over(until_here))
        measures["_total"] = F.sum(F.coalesce(F.col(total), F.lit(0)))

    offsets = _offsets(staged, groups, measures)
    match = F.col("_range") == F.col("_o_range")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    shifted = numbered.join(F.broadcast(offsets), match, "left").withColumn(
        rank, F.col(rank) + F.coalesce("_o_rows", F.lit(0))
    )
    if total:
        shifted = shifted.withColumn(running, F.col(running) + F.coalesce(F.col("_o_total"), F.lit(0)))
    return shifted.drop("_range", *offsets.columns)


def _offsets(staged: DataFrame, groups: list[str], measures: dict[str, Column]) -> DataFrame:
    """Totals of the earlier ranges, at most two rows per range, so safe to broadcast."""
    if groups:
        # ranges are contiguous: a group spans several only if it is the last group of one of them
        last_group = staged.groupBy("_range").agg(F.max(F.struct(*groups)).alias("_g"))
        spanning = last_group.select(*[F.col("_g")[g].alias(f"_s_{g}") for g in groups]).distinct()
        match = [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in groups]
        parts = staged.join(F.broadcast(spanning), match, "left_semi")
    else:
        parts = staged
    per_range = parts.groupBy("_range", *groups).agg(*[c.alias(n) for n, c in measures.items()])
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        F.col("_range").alias("_o_range"),
        *[F.col(g).alias(f"_o_{g}") for g in groups],
        *[F.sum(n).over(before).alias(f"_o{n}") for n in measures],
    )
