"""Delivery performance and review scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cuts import exact_quantiles

LATE, ON_TIME = "Late", "On time / early"


def _reviewed(delivered_orders: DataFrame) -> DataFrame:
    label = F.when(F.col("is_late_delivery") == 1, LATE).otherwise(ON_TIME)
    return delivered_orders.where(F.col("review_score").isNotNull()).select(
        label.alias("delivery_status"), "review_score"
    )


def review_distribution(delivered_orders: DataFrame) -> DataFrame:
    """Orders per rounded score 1..5; halves round to the even neighbour."""
    rounded = F.greatest(F.least(F.bround("review_score", 0), F.lit(5.0)), F.lit(1.0)).cast("int")
    counted = _reviewed(delivered_orders).groupBy(rounded.alias("review_score_rounded")).agg(
        F.count("*").alias("orders")
    )
    scores = delivered_orders.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("review_score_rounded"))
    return scores.join(counted, "review_score_rounded", "left").fillna({"orders": 0})


def review_by_lateness(delivered_orders: DataFrame) -> DataFrame:
    return (
        _reviewed(delivered_orders)
        .groupBy("delivery_status")
        .agg(F.count("*").alias("orders"), F.avg("review_score").alias("avg_review"))
    )


def review_box_stats(delivered_orders: DataFrame, **limits) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers of the review score per delivery label."""
    reviewed = _reviewed(delivered_orders)
    boxes = []
    for label in (LATE, ON_TIME):
        q1, median, q3 = exact_quantiles(
            reviewed.where(F.col("delivery_status") == label), "review_score", [0.25, 0.5, 0.75], **limits
        )
        if q1 is not None:
            boxes.append((label, q1, median, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    schema = "delivery_status string, q1 double, median double, q3 double, _low double, _high double"
    box = delivered_orders.sparkSession.createDataFrame(boxes, schema)
    inside = F.col("review_score").between(F.col("_low"), F.col("_high"))
    return (
        reviewed.join(F.broadcast(box), "delivery_status")
        .groupBy("delivery_status", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("review_score"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("review_score"))).alias("whisker_high"),
        )
    )
