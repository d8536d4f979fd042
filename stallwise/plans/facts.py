"""Item fact, order fact and the status filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flag, great_circle_km, mean_of, ratio
from ..operators.grouping import Layout, combined_on, mark_values, smallest_mode
from .enrich import with_time_features

# The order states that count as completed and as delivered.
COMPLETED_STATUSES = ("delivered", "shipped", "invoiced", "processing", "approved")
DELIVERED_STATUS = "delivered"

# sellers with their attributes that may be broadcast: some 100 bytes each
FEW_SELLERS = 500_000

_PRODUCT_COLUMNS = [
    "product_category_name",
    "product_category_name_english",
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
]
_SELLER_COLUMNS = ["seller_zip_code_prefix", "seller_city", "seller_state", "seller_lat", "seller_lng"]
_ORDER_COLUMNS = [
    "customer_id",
    "customer_unique_id",
    "customer_zip_code_prefix",
    "customer_city",
    "customer_state",
    "customer_lat",
    "customer_lng",
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "payment_value",
    "payment_installments",
    "payment_type",
    "payment_type_nunique",
    "review_score",
    "review_comment_rate",
    "review_count",
]


def order_item_base(
    items: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    orders: DataFrame,
    buckets: int | None = None,
    few_sellers: bool = False,
) -> DataFrame:
    """Every item with its product, seller and order attributes; no item is ever dropped.

    Left joins only. Small dimensions are broadcast by size; large ones become sort-merge
    joins whose hot keys AQE can split, because nothing above relies on their partitioning.
    With ``buckets`` the result lies by order in so many partitions: the rows are shuffled on the
    order before its attributes widen them, and the last join keeps them there. ``few_sellers`` are broadcast
    behind that shuffle, which then does without their columns.
    """
    gmv = F.col("price") + F.col("freight_value")
    side = [F.coalesce(F.col(f"product_{d}_cm"), F.lit(0)).cast("bigint") for d in ("length", "height", "width")]
    described = items.join(products.select("product_id", *_PRODUCT_COLUMNS), "product_id", "left")
    located = sellers.select("seller_id", *_SELLER_COLUMNS)
    if not few_sellers:
        described = described.join(located, "seller_id", "left")
    if buckets:
        described = described.repartition(buckets, "order_id")
    if few_sellers:
        described = described.join(F.broadcast(located), "seller_id", "left")
    return (
        described.join(orders.select("order_id", *_ORDER_COLUMNS), "order_id", "left")
        .select(
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            "shipping_limit_date",
            "price",
            "freight_value",
            *_PRODUCT_COLUMNS,
            *_SELLER_COLUMNS,
            *_ORDER_COLUMNS,
            gmv.alias("item_gmv"),
            ratio(F.col("freight_value"), gmv).alias("freight_share"),
            (side[0] * side[1] * side[2]).alias("volume_cm3"),
            flag(F.col("customer_state") == F.col("seller_state")).alias("same_state_route"),
        )
    )


def order_item_geo(item_base: DataFrame) -> DataFrame:
    return item_base.withColumn(
        "distance_km",
        great_circle_km(F.col("customer_lat"), F.col("customer_lng"), F.col("seller_lat"), F.col("seller_lng")),
    )


def order_level(item_geo: DataFrame, enriched_orders: DataFrame, layout: Layout = Layout.ANY) -> DataFrame:
    """One row per order that has items."""
    return order_features(order_totals(item_geo, enriched_orders, layout))


def order_features(orders: DataFrame) -> DataFrame:
    """Columns that follow from others of the row; they are added after the last shuffle."""
    gap = F.col("payment_value") - F.col("order_gmv")
    return with_time_features(orders.drop("purchase_month")).withColumn("gmv_payment_gap", gap)


def order_totals(item_geo: DataFrame, enriched_orders: DataFrame, layout: Layout = Layout.ANY) -> DataFrame:
    """Sums and attributes of every order that has items.

    Items are combined per (order, seller, category) and every later step reuses one order_id
    partitioning. Order attributes are joined afterwards instead of being dragged through the
    aggregate, which lets a status filter reach the orders table.
    """
    category = "product_category_name_english"

    def per_seller_and_category(items: DataFrame) -> DataFrame:
        return items.groupBy("order_id", "seller_id", category).agg(
            F.sum("item_gmv").alias("_gmv"),
            F.sum("freight_value").alias("_freight"),
            F.count("order_item_id").alias("_items"),
            F.count("*").alias("_rows"),
            F.sum("distance_km").alias("_km"),
            F.count("distance_km").alias("_km_n"),
        )

    narrow = item_geo.select(
        "order_id", "order_item_id", "seller_id", category, "item_gmv", "freight_value", "distance_km"
    )
    combined = combined_on(narrow, "order_id", per_seller_and_category, layout)
    marked = mark_values(combined, "order_id", "seller_id", "_rows", category, "_seller")
    marked = mark_values(marked, "order_id", category, "_rows", "seller_id", "_category")
    totals = marked.groupBy("order_id").agg(
        F.sum("_gmv").alias("order_gmv"),
        F.sum("_freight").alias("freight_gmv"),
        F.sum("_items").alias("item_count"),
        F.sum("_seller_first").alias("seller_count"),
        F.sum("_category_first").alias("category_count"),
        smallest_mode(category, "_category_weight").alias("dominant_category"),
        ratio(F.sum("_km"), F.sum("_km_n")).alias("avg_distance_km"),
    )
    attributes = enriched_orders.select(
        "order_id",
        "customer_unique_id",
        "customer_state",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "review_score",
        "payment_value",
        "payment_installments",
        "payment_type",
    )
    joined = totals.join(attributes, "order_id", "left")
    return joined.select(
        *attributes.columns,
        "order_gmv",
        "freight_gmv",
        "item_count",
        "seller_count",
        "category_count",
        "dominant_category",
        "avg_distance_km",
    )


def completed(df: DataFrame) -> DataFrame:
    return df.where(F.col("order_status").isin(*COMPLETED_STATUSES))


def delivered(df: DataFrame) -> DataFrame:
    return df.where(F.col("order_status") == DELIVERED_STATUS)


def completed_orders_summary(completed_orders: DataFrame) -> DataFrame:
    return completed_orders.agg(
        F.count("order_id").alias("completed_orders"),
        F.sum("order_gmv").alias("total_gmv"),
        mean_of("order_gmv").alias("avg_order_gmv"),
    )


def _preview(df: DataFrame, order: list[str], digits: dict[str, int], columns: list[str], rows: int) -> DataFrame:
    shown = [F.bround(F.col(c).cast("double"), digits[c]).alias(c) if c in digits else F.col(c) for c in columns]
    # coalesce keeps later projections above the limit, so that this stays a top-k and not a full sort
    return df.orderBy(*order).limit(rows).coalesce(1).select(*shown)


def item_preview(item_geo: DataFrame, rows: int = 5) -> DataFrame:
    return _preview(
        item_geo,
        ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "shipping_limit_date"],
        {"item_gmv": 2, "freight_share": 2, "volume_cm3": 0},
        ["order_id", "product_category_name_english", "item_gmv", "freight_share", "volume_cm3", "same_state_route"],
        rows,
    )


def distance_preview(item_geo: DataFrame, rows: int = 5) -> DataFrame:
    return _preview(
        item_geo,
        ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "shipping_limit_date"],
        {"distance_km": 1},
        ["order_id", "customer_state", "seller_state", "distance_km"],
        rows,
    )


def order_preview(completed_orders: DataFrame, rows: int = 5) -> DataFrame:
    return _preview(
        completed_orders,
        ["order_id"],
        {"order_gmv": 2, "delivery_days": 1, "avg_distance_km": 1},
        [
            "order_id",
            "customer_state",
            "order_status",
            "order_gmv",
            "delivery_days",
            "is_late_delivery",
            "avg_distance_km",
            "dominant_category",
        ],
        rows,
    )


def customer_preview(customer_level: DataFrame, rows: int = 5) -> DataFrame:
    filled = customer_level.fillna({"purchase_frequency_per_month": 0.0})
    return _preview(
        filled,
        ["customer_unique_id"],
        {"total_gmv": 2, "avg_order_value": 2, "recency_days": 0, "purchase_frequency_per_month": 2},
        [
            "customer_unique_id",
            "total_orders",
            "total_gmv",
            "avg_order_value",
            "recency_days",
            "purchase_frequency_per_month",
            "repeat_customer",
            "value_segment",
        ],
        rows,
    )
