"""Group-wise helpers that pre-aggregate before they shuffle."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 200_000
# a key seen less often in the sample says nothing; one with so few rows is no burden for a task
LEAST_HITS, LIGHT_ROWS = 5, 100_000


class Layout(Enum):
    """What is known of the rows per key: nothing, that no key is heavy, or that the rows already lie by key."""

    ANY = "any"
    LIGHT = "light"
    PLACED = "placed"


def layout_of(df: DataFrame, key: str) -> Layout:
    """LIGHT unless a key holds much of what one shuffle partition should hold, by a sample of one column.

    ``df`` should be a table, so that its count is metadata. The answer picks a plan and changes no result.
    """
    rows = df.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    drawn = df.select(key) if share == 1.0 else df.select(key).sample(share, seed=17)
    hits = drawn.groupBy(key).agg(F.count("*").alias("hits")).agg(F.max("hits")).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = hits >= LEAST_HITS and hits / share > max(LIGHT_ROWS, rows / (4 * partitions))
    return Layout.ANY if heavy else Layout.LIGHT


def combined_on(
    df: DataFrame,
    key: str,
    combine: Callable[[DataFrame], DataFrame],
    layout: Layout = Layout.ANY,
    buckets: int | None = None,
) -> DataFrame:
    """``combine`` (a grouping on ``key`` and more columns) with a result partitioned on ``key``.

    Rows that lie by key need no shuffle, rows without heavy keys one. Otherwise they are combined on the map
    side first, so a heavy key reaches its task as one row per task and group, and the combined rows are
    shuffled on the key. With ``buckets`` they are dealt into so many partitions.
    """
    dealt = (key,) if buckets is None else (buckets, key)
    if layout is Layout.PLACED:
        return combine(df)
    if layout is Layout.LIGHT:
        return combine(df.repartition(*dealt))
    return combine(df).repartition(*dealt)


def smallest_mode(value: str, weight: str) -> Column:
    """Most frequent value over pre-counted rows; ties go to the smallest, NULLs are ignored.

    Rows must already be counted per value (one row per group and value), so the
    aggregation buffer is one struct per group however large the group is.
    """
    candidate = F.when(F.col(value).isNotNull(), F.struct((-F.col(weight)).alias("neg"), F.col(value).alias("v")))
    return F.min(candidate)["v"]


def mark_values(df: DataFrame, within: str, value: str, weight: str, tie: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_first`` (1 on one row per group and value) and ``{prefix}_weight``.

    For rows that are pre-combined and already partitioned on ``within``: it needs a sort but no
    shuffle, and several values can be counted on the same rows without copying them.
    """
    same = Window.partitionBy(within, value)
    first = F.row_number().over(same.orderBy(tie)) == 1
    whole = same.orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns(
        {
            f"{prefix}_first": F.when(first & F.col(value).isNotNull(), F.lit(1)).otherwise(F.lit(0)),
            f"{prefix}_weight": F.sum(weight).over(whole),
        }
    )
