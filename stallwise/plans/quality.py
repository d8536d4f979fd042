"""Row counts, declared-key checks and coverage of the raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, RawTables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(raw: RawTables) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in raw.items()]
    return _union(counts).orderBy("table_name")


def primary_key_check(raw: RawTables) -> DataFrame:
    """Per table: key groups with more than one row, and rows with a NULL in the key."""
    tables = dict(raw.items())

    def check(name: str, key: list[str]) -> DataFrame:
        broken = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        return (
            tables[name]
            .groupBy(*key)
            .agg(F.count("*").alias("_rows"))
            .agg(
                F.lit(name).alias("table_name"),
                F.count(F.when(~broken & (F.col("_rows") > 1), 1)).alias("dup_groups"),
                F.coalesce(F.sum(F.when(broken, F.col("_rows"))), F.lit(0)).alias("null_keys"),
            )
        )

    return _union([check(name, key) for name, key in PRIMARY_KEYS.items()])


def foreign_key_check(raw: RawTables) -> DataFrame:
    """Child rows whose non-null key has no parent; children are combined per key first."""
    tables = dict(raw.items())

    def check(child: str, column: str, parent: str, target: str) -> DataFrame:
        used = (
            tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
                F.count("*").alias("_rows")
            )
        )
        known = tables[parent].select(F.col(target).alias("_key"))
        return used.join(known, "_key", "left_anti").agg(
            F.lit(child).alias("child_table"),
            F.lit(column).alias("child_column"),
            F.lit(parent).alias("parent_table"),
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphans"),
        )

    return _union([check(*fk) for fk in FOREIGN_KEYS])


def purchase_coverage(orders: DataFrame) -> DataFrame:
    ts = "order_purchase_timestamp"
    return orders.agg(
        F.to_date(F.min(ts)).alias("purchase_start"), F.to_date(F.max(ts)).alias("purchase_end")
    )
