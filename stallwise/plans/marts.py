"""Category, seller, state, route and distance marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mean_of, ratio
from ..operators.cuts import SortKey, cut_points, exact_quantiles, key_order, tile_starts
from ..operators.running import with_running
from .enrich import late_flag

CATEGORY = "product_category_name_english"


def category_summary(completed_items: DataFrame) -> DataFrame:
    return completed_items.groupBy(CATEGORY).agg(
        F.sum("item_gmv").alias("gmv"),
        F.count_distinct("order_id").alias("orders"),
        F.avg("review_score").alias("avg_review"),
        ratio(F.sum("freight_value"), F.sum("item_gmv")).alias("avg_freight_share"),
    )


def top_categories(categories: DataFrame, n: int = 10) -> DataFrame:
    return categories.orderBy(F.col("gmv").desc_nulls_last(), CATEGORY).limit(n)


def category_scatter(categories: DataFrame, min_orders: int = 100) -> DataFrame:
    return categories.where(F.col("orders") >= min_orders)


def fix_categories(categories: DataFrame) -> DataFrame:
    """Large categories with a below-median review; cut-offs come from the full table."""
    (gmv_cutoff,) = exact_quantiles(categories, "gmv", [0.75])
    (review_cutoff,) = exact_quantiles(categories, "avg_review", [0.5])
    return categories.where(
        (F.col("gmv").cast("double") >= F.lit(gmv_cutoff)) & (F.col("avg_review") < F.lit(review_cutoff))
    ).orderBy(F.col("gmv").desc(), CATEGORY)


def seller_base(completed_items: DataFrame) -> DataFrame:
    """Seller totals; the late flag comes from the item row, so the fact is not joined to itself.

    Counting orders and customers in steps (order -> customer -> seller) replaces two DISTINCT
    counts, which would copy every item three times, and spreads a hot seller over its orders.
    """
    sums = ["_gmv", "_items", "_late", "_score", "_scored"]
    per_order = completed_items.groupBy("seller_id", "customer_unique_id", "order_id").agg(
        F.sum("item_gmv").alias("_gmv"),
        F.count("*").alias("_items"),
        F.sum(late_flag()).alias("_late"),
        F.sum("review_score").alias("_score"),
        F.count("review_score").alias("_scored"),
    )
    per_customer = per_order.groupBy("seller_id", "customer_unique_id").agg(
        F.count("order_id").alias("_orders"), *[F.sum(c).alias(c) for c in sums]
    )
    return per_customer.groupBy("seller_id").agg(
        F.sum("_gmv").alias("gmv"),
        F.sum("_orders").alias("orders"),
        F.count("customer_unique_id").alias("customers"),
        ratio(F.sum("_score"), F.sum("_scored")).alias("avg_review"),
        ratio(F.sum("_late"), F.sum("_items")).alias("late_delivery_rate"),
    )


def seller_summary(sellers: DataFrame, **options) -> DataFrame:
    """Seller totals plus running GMV share, largest first (ties by seller id)."""
    ranked = with_running(
        sellers,
        order=[F.col("gmv").desc_nulls_last(), F.col("seller_id").asc_nulls_last()],
        rank="seller_rank",
        total="gmv",
        running="_running",
        **options,
    )
    total = sellers.agg(F.sum("gmv")).scalar()
    return ranked.withColumn("cumulative_gmv_share", ratio(F.col("_running"), total)).drop("_running")


def top_sellers(sellers: DataFrame, n: int = 5) -> DataFrame:
    return sellers.orderBy(F.col("gmv").desc_nulls_last(), "seller_id").limit(n)


def seller_topk_share(summary: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    def share(k: int) -> F.Column:
        return ratio(F.sum(F.when(F.col("seller_rank") <= k, F.col("gmv"))), F.sum("gmv"))

    return summary.agg(*[share(k).alias(f"top{k}_share") for k in ks])


def risky_sellers(sellers: DataFrame, min_orders: int = 100, n: int = 10) -> DataFrame:
    return (
        sellers.where(F.col("orders") >= min_orders)
        .orderBy(F.col("avg_review").asc_nulls_last(), F.col("gmv").desc_nulls_last(), "seller_id")
        .limit(n)
    )


def seller_pareto_curve(summary: DataFrame) -> DataFrame:
    count = summary.agg(F.count("*")).scalar()
    return summary.select(
        "seller_id",
        "seller_rank",
        ratio(F.col("seller_rank"), count).alias("seller_percentile"),
        "cumulative_gmv_share",
    )


def seller_scatter(sellers: DataFrame, min_orders: int = 20) -> DataFrame:
    return sellers.where(F.col("orders") >= min_orders)


def state_summary(completed_orders: DataFrame) -> DataFrame:
    return completed_orders.groupBy("customer_state").agg(
        F.sum("order_gmv").alias("gmv"),
        F.count("order_id").alias("orders"),
        F.count_distinct("customer_unique_id").alias("customers"),
        F.avg("review_score").alias("avg_review"),
        ratio(F.sum("order_gmv"), F.count("order_id")).alias("avg_order_value"),
    )


def top_states(states: DataFrame, n: int = 10) -> DataFrame:
    return states.orderBy(F.col("gmv").desc_nulls_last(), "customer_state").limit(n)


def route_summary(completed_items: DataFrame) -> DataFrame:
    """Same-state against cross-state items; the share window runs over two rows."""
    route = F.when(F.col("same_state_route") == 1, "same_state").otherwise("cross_state")
    totals = completed_items.groupBy(route.alias("route_type")).agg(
        F.count("*").alias("items"),
        F.sum("item_gmv").alias("gmv"),
        mean_of("freight_value").alias("avg_freight"),
        F.avg("review_score").alias("avg_review"),
    )
    return totals.withColumn("gmv_share", ratio(F.col("gmv"), F.sum("gmv").over(Window.partitionBy())))


def distance_summary(completed_items: DataFrame, tiles: int = 5, **limits) -> DataFrame:
    """Distance quintiles of the item fact without ranking it.

    Rows are ordered by (distance, freight, review), so rows that tie completely contribute the
    same values whichever tile they fall in. The four cut keys split the table into zones; one
    aggregate sums each zone, and rows equal to a cut key are divided between the tiles by count.
    """
    spark = completed_items.sparkSession
    order = ["distance_km", "freight_value", "review_score"]
    located = completed_items.where(F.col("distance_km").isNotNull()).select(*order)
    rows = located.count()
    starts = tile_starts(rows, tiles)
    cuts = cut_points(located, order, starts, rows=rows, **limits)
    key = SortKey(order)
    distinct = {c.key: c for c in cuts.values()}
    edges = sorted(distinct, key=key_order)
    zones = located.groupBy(key.zone_number(edges).alias("_zone")).agg(
        F.count("*").alias("_n"),
        F.sum("distance_km").alias("_km"),
        F.sum("freight_value").cast("double").alias("_freight"),
        F.count("freight_value").alias("_freight_n"),
        F.sum("review_score").alias("_score"),
        F.count("review_score").alias("_score_n"),
    )
    shares = spark.createDataFrame(
        _zone_shares([distinct[e] for e in edges], [1, *starts], rows), "_zone int, distance_bucket int, _part double"
    )
    part = F.col("_part") / F.col("_n")

    def mean(total: str, count: str) -> F.Column:
        return ratio(F.sum(F.col(total) * part), F.sum(F.col(count) * part))

    return (
        zones.join(F.broadcast(shares), "_zone")
        .groupBy("distance_bucket")
        .agg(
            mean("_km", "_n").alias("avg_distance_km"),
            mean("_freight", "_freight_n").alias("avg_freight"),
            mean("_score", "_score_n").alias("avg_review"),
        )
    )


def _zone_shares(cuts: list, starts: list[int], rows: int) -> list[tuple[int, int, float]]:
    """(zone, tile, rows of the zone that belong to the tile); zones alternate between / on a cut."""
    spans = []
    position = 0
    for i, cut in enumerate(cuts):
        spans.append((2 * i, position, cut.below))
        spans.append((2 * i + 1, cut.below, cut.below + cut.equal))
        position = cut.below + cut.equal
    spans.append((2 * len(cuts), position, rows))
    ends = [s - 1 for s in starts[1:]] + [rows]
    shares = []
    for zone, first, last in spans:
        for tile, (start, end) in enumerate(zip(starts, ends), 1):
            overlap = min(last, end) - max(first, start - 1)
            if overlap > 0:
                shares.append((zone, tile, float(overlap)))
    return shares
