"""Customer mart: aggregates, recency/frequency features, value segments, realised value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import days_between, flag, mean_of, ratio
from ..operators.cuts import exact_quantiles, with_ntile

# Value segments from the lowest to the highest quartile; days per month.
SEGMENTS = ("Low", "Mid-Low", "Mid-High", "High")
DAYS_PER_MONTH = 30.4


def customer_agg(completed_orders: DataFrame) -> DataFrame:
    ts = "order_purchase_timestamp"
    return completed_orders.groupBy("customer_unique_id").agg(
        F.sum("order_gmv").alias("total_gmv"),
        F.count("order_id").alias("total_orders"),
        F.min(ts).alias("first_purchase"),
        F.max(ts).alias("last_purchase"),
        mean_of("order_gmv").alias("avg_order_value"),
        F.avg("review_score").alias("avg_review_score"),
        F.avg("delivery_days").alias("avg_delivery_days"),
        F.avg("is_late_delivery").alias("late_delivery_rate"),
    )


def customer_rfm(customers: DataFrame) -> DataFrame:
    """Recency anchors on the last completed order of all customers, read as a scalar subquery."""
    analysis_end = customers.agg(F.max("last_purchase")).scalar()
    active_days = days_between("first_purchase", "last_purchase")
    return customers.withColumns(
        {
            "recency_days": days_between(F.col("last_purchase"), analysis_end),
            "tenure_days": F.greatest(active_days, F.lit(0.0)),
            "purchase_frequency_per_month": F.when(
                active_days > 0, F.col("total_orders") / (active_days / F.lit(DAYS_PER_MONTH))
            ),
            "realized_ltv": F.col("total_gmv"),
            "repeat_customer": flag(F.col("total_orders") > 1),
        }
    )


def customer_level(rfm: DataFrame, **limits) -> DataFrame:
    """Value quartiles over (realized_ltv, customer id); ``rfm`` should be a written table."""
    tiled = with_ntile(rfm, ["realized_ltv", "customer_unique_id"], 4, "value_quartile", **limits)
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    return tiled.withColumn("value_segment", F.element_at(names, F.col("value_quartile")))


def repeat_customer_rate(customers: DataFrame) -> DataFrame:
    return customers.agg(F.avg("repeat_customer").alias("repeat_customer_rate"))


def ltv_segment_summary(customers: DataFrame) -> DataFrame:
    """One row per segment, also for segments without customers (at most four rows)."""
    spark = customers.sparkSession
    summary = customers.groupBy("value_segment").agg(
        F.count("customer_unique_id").alias("customers"),
        F.sum("realized_ltv").alias("gmv"),
        F.avg("total_orders").alias("avg_orders"),
        F.avg("avg_review_score").alias("avg_review"),
        F.avg("recency_days").alias("avg_recency_days"),
    )
    known = spark.createDataFrame(list(enumerate(SEGMENTS, 1)), "segment_rank int, value_segment string")
    full = known.join(summary, "value_segment", "left").select(
        "segment_rank",
        "value_segment",
        F.coalesce("customers", F.lit(0)).alias("customers"),
        F.coalesce(F.col("gmv").cast("double"), F.lit(0.0)).alias("gmv"),
        "avg_orders",
        "avg_review",
        "avg_recency_days",
    )
    return full.withColumn("gmv_share", ratio(F.col("gmv"), F.sum("gmv").over(Window.partitionBy())))


def high_segment_share(segment_summary: DataFrame) -> DataFrame:
    return segment_summary.where(F.col("value_segment") == SEGMENTS[-1]).select(
        F.col("gmv_share").alias("high_segment_share")
    )


def ltv_quantiles(customers: DataFrame, **limits) -> DataFrame:
    median, p90, p99 = exact_quantiles(customers, "realized_ltv", [0.5, 0.9, 0.99], **limits)
    return customers.sparkSession.createDataFrame(
        [(median, p90, p99)], "median_ltv double, p90_ltv double, p99_ltv double"
    )


def ltv_histogram(customers: DataFrame, bins: int = 60) -> DataFrame:
    """Equal-width bins over the full range of realized_ltv; the last bin includes the maximum."""
    spark = customers.sparkSession
    values = customers.select(F.col("realized_ltv").cast("double").alias("v")).where(F.col("v").isNotNull())
    edges = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    with_edges = values.withColumn("e", edges)
    flat = F.col("e.low") == F.col("e.high")
    low = F.when(flat, F.col("e.low") - 0.5).otherwise(F.col("e.low"))
    high = F.when(flat, F.col("e.high") + 0.5).otherwise(F.col("e.high"))
    position = F.floor((F.col("v") - low) / (high - low) * bins)
    counted = with_edges.groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("customers"), F.min(low).alias("_low"), F.max(high).alias("_high")
    )
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    everything = Window.partitionBy()  # one row per bin
    width = (F.max("_high").over(everything) - F.min("_low").over(everything)) / bins
    start = F.min("_low").over(everything)
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        (start + F.col("bin") * width).alias("bin_start"),
        (start + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("customers", F.lit(0)).alias("customers"),
    )
