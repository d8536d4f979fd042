"""Monthly KPIs, acquisition mix and cohort retention.

Every table after the first aggregate has one row per month or per cohort and month, so the
unpartitioned windows below see a few hundred rows at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag, month_number, month_of, ratio
from ..operators.grouping import Layout, combined_on
from ..operators.running import with_running

CUSTOMER = "customer_unique_id"


def monthly_metrics(completed_orders: DataFrame) -> DataFrame:
    return completed_orders.groupBy("purchase_month").agg(
        F.sum("order_gmv").alias("gmv"),
        F.count("order_id").alias("orders"),
        F.count_distinct(CUSTOMER).alias("active_customers"),
        ratio(F.sum("order_gmv"), F.count("order_id")).alias("aov"),
    )


def without_last_month(monthly: DataFrame) -> DataFrame:
    """Drop the last month, which is taken to be incomplete."""
    last = F.max("purchase_month").over(Window.partitionBy())
    return monthly.withColumn("_last", last).where(F.col("purchase_month") < F.col("_last")).drop("_last")


def monthly_metrics_full(monthly: DataFrame, min_orders: int = 0) -> DataFrame:
    return without_last_month(monthly).where(F.col("orders") >= min_orders)


def growth_summary(monthly: DataFrame, min_orders: int = 100) -> DataFrame:
    """Peak month and growth from the first to the last month with enough orders."""
    month, gmv = "purchase_month", "gmv"
    trend = monthly_metrics_full(monthly, min_orders)
    best = F.struct(F.col(gmv), -month_number(month))
    summary = trend.agg(
        F.max_by(month, best).alias("peak_month"),
        F.max(gmv).alias("peak_gmv"),
        F.min(month).alias("first_month"),
        F.min_by(gmv, month).alias("first_gmv"),
        F.max(month).alias("last_month"),
        F.max_by(gmv, month).alias("last_gmv"),
    )
    return summary.withColumn("gmv_growth", ratio(F.col("last_gmv"), F.col("first_gmv")) - 1)


def order_sequence(completed_orders: DataFrame, **options) -> DataFrame:
    """Position of every order in its customer's history; a customer may hold any share of the rows."""
    ranked = with_running(
        completed_orders.select("order_id", CUSTOMER, "purchase_month", "order_purchase_timestamp"),
        order=[F.col("order_purchase_timestamp").asc_nulls_last(), F.col("order_id").asc_nulls_last()],
        within=[CUSTOMER],
        rank="order_rank",
        **options,
    )
    return ranked.withColumns(
        {"is_new_order": flag(F.col("order_rank") == 1), "is_repeat_order": flag(F.col("order_rank") > 1)}
    )


def monthly_customer_mix(completed_orders: DataFrame) -> DataFrame:
    """New versus returning activity per month.

    The first order of a customer lies in the customer's first month, so counting customers by
    first month replaces numbering all orders.
    """
    active = completed_orders.groupBy("purchase_month", CUSTOMER).agg(F.count("order_id").alias("_orders"))
    per_month = active.groupBy("purchase_month").agg(
        F.count(CUSTOMER).alias("active_customers"), F.sum("_orders").alias("total_orders")
    )
    starts = active.groupBy(CUSTOMER).agg(F.min("purchase_month").alias("_month"))
    new = starts.groupBy("_month").agg(F.count("*").alias("new_customers"))
    mixed = per_month.join(new, per_month["purchase_month"].eqNullSafe(new["_month"]), "left").withColumn(
        "new_customers", F.coalesce("new_customers", F.lit(0))
    )
    repeats = F.col("total_orders") - F.col("new_customers")
    return mixed.select(
        "purchase_month",
        "active_customers",
        "new_customers",
        repeats.alias("repeat_orders"),
        "total_orders",
        (F.col("active_customers") - F.col("new_customers")).alias("returning_customer_proxy"),
        ratio(repeats, F.col("total_orders")).alias("repeat_order_share"),
    )


def avg_repeat_share(mix: DataFrame) -> DataFrame:
    return without_last_month(mix).agg(F.avg("repeat_order_share").alias("avg_repeat_share"))


def cohort_activity(completed_orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Cohort and calendar-month distance for every order.

    The first month comes from the written customer table, not from a window over the orders:
    both sides of the join are plain shuffles (or one is broadcast by size), so AQE can split
    the rows of a customer with very many orders.
    """
    orders = completed_orders.select(
        CUSTOMER, "order_id", month_of("order_purchase_timestamp").alias("order_month")
    )
    starts = customers.select(F.col(CUSTOMER).alias("_who"), month_of("first_purchase").alias("cohort_month"))
    return (
        orders.join(starts, F.col(CUSTOMER).eqNullSafe(F.col("_who")))
        .withColumn("cohort_index", month_number("order_month") - month_number("cohort_month"))
        .select(CUSTOMER, "order_id", "cohort_month", "order_month", "cohort_index")
    )


def cohort_retention(completed_orders: DataFrame, layout: Layout = Layout.ANY) -> DataFrame:
    """Zero-filled retention grid from each cohort's first month to the last month of all."""
    months = completed_orders.select(CUSTOMER, month_of("order_purchase_timestamp").alias("order_month"))
    active = combined_on(months, CUSTOMER, DataFrame.distinct, layout)
    # at most one row per calendar month and customer is left, so this window stays small
    start = F.min("order_month").over(Window.partitionBy(CUSTOMER))
    counts = (
        active.withColumn("cohort_month", start)
        .withColumn("cohort_index", month_number("order_month") - month_number("cohort_month"))
        .groupBy("cohort_month", "cohort_index")
        .agg(F.count(CUSTOMER).alias("customers"))
    )
    last = F.max(month_number("cohort_month") + F.col("cohort_index")).over(Window.partitionBy())
    cohort = Window.partitionBy("cohort_month")
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("customers"))).over(cohort)
    marked = counts.withColumn("_steps", last - month_number("cohort_month")).withColumn("cohort_size", size)
    grid = marked.where((F.col("cohort_index") == 0) & (F.col("_steps") >= 0)).select(
        "cohort_month", "cohort_size", F.explode(F.sequence(F.lit(0), F.col("_steps"))).alias("cohort_index")
    )
    return grid.join(counts, ["cohort_month", "cohort_index"], "left").select(
        "cohort_month",
        "cohort_index",
        F.coalesce("customers", F.lit(0)).alias("customers"),
        "cohort_size",
        ratio(F.coalesce("customers", F.lit(0)), F.col("cohort_size")).alias("retention"),
    )


def cohort_check(retention: DataFrame, min_size: int = 100, max_index: int = 12) -> DataFrame:
    kept = (F.col("cohort_size") >= min_size) & (F.col("cohort_index") <= max_index)
    return retention.where(kept).orderBy("cohort_month", "cohort_index")


def cohort_matrix(retention: DataFrame, min_size: int = 100, max_index: int = 12, scale: float = 100.0) -> DataFrame:
    """Cohorts as rows, months since the first purchase as columns ``m0`` .. ``m12``."""
    indexes = list(range(max_index + 1))
    pivoted = (
        retention.where((F.col("cohort_size") >= min_size) & (F.col("cohort_index") <= max_index))
        .groupBy("cohort_month")
        .pivot("cohort_index", indexes)
        .agg(F.first("retention"))
    )
    columns = [(F.col(str(i)) * F.lit(scale)).alias(f"m{i}") for i in indexes]
    return pivoted.select("cohort_month", *columns).orderBy("cohort_month")


def cohort_heatmap(retention: DataFrame, min_size: int = 100, max_index: int = 12) -> DataFrame:
    """Months 1..12 as two-digit percentages, empty where the cohort has no such month."""
    matrix = cohort_matrix(retention, min_size, max_index, 100.0)
    labels = [
        F.coalesce(F.concat(F.format_number(f"m{i}", 2), F.lit("%")), F.lit("")).alias(f"m{i}")
        for i in range(1, max_index + 1)
    ]
    return matrix.select(F.col("cohort_month").cast("string").alias("cohort"), *labels)


def avg_retention(retention: DataFrame, min_size: int = 100) -> DataFrame:
    def at(index: int) -> F.Column:
        return F.avg(F.when(F.col("cohort_index") == index, F.col("retention")))

    return retention.where(F.col("cohort_size") >= min_size).agg(
        at(1).alias("avg_retention_m1"), at(3).alias("avg_retention_m3")
    )
