"""Dimension joins and per-order pre-aggregation (silver layer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import days_between, flag, hours_between, month_of, ratio
from ..operators.grouping import Layout, combined_on, mark_values, smallest_mode


def products_enriched(products: DataFrame, translation: DataFrame) -> DataFrame:
    english = translation.select(
        F.col("product_category_name").alias("_source_name"),
        F.col("product_category_name_english").alias("_english_name"),
    )
    joined = products.join(english, products["product_category_name"] == english["_source_name"], "left")
    return joined.select(
        "product_id",
        F.coalesce("product_category_name", F.lit("unknown")).alias("product_category_name"),
        F.coalesce("_english_name", F.lit("unknown")).alias("product_category_name_english"),
        "product_name_lenght",
        "product_description_lenght",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def geo_zip(geolocation: DataFrame) -> DataFrame:
    """One row per zip: mean coordinates, most frequent city and state.

    A single pass counts (zip, city, state); means and modes come from that small table, so
    a zip with a huge share of the rows is combined before it is shuffled.
    """
    zip_code, city, state = "geolocation_zip_code_prefix", "geolocation_city", "geolocation_state"
    counted = (
        geolocation.groupBy(zip_code, city, state)
        .agg(
            F.count("*").alias("_n"),
            F.sum("geolocation_lat").alias("_lat"),
            F.count("geolocation_lat").alias("_lat_n"),
            F.sum("geolocation_lng").alias("_lng"),
            F.count("geolocation_lng").alias("_lng_n"),
        )
        .repartition(zip_code)
    )
    marked = mark_values(counted, zip_code, city, "_n", state, "_city")
    marked = mark_values(marked, zip_code, state, "_n", city, "_state")
    return marked.groupBy(zip_code).agg(
        ratio(F.sum("_lat"), F.sum("_lat_n")).alias("geolocation_lat"),
        ratio(F.sum("_lng"), F.sum("_lng_n")).alias("geolocation_lng"),
        smallest_mode(city, "_city_weight").alias(city),
        smallest_mode(state, "_state_weight").alias(state),
    )


def _with_geo(df: DataFrame, geo: DataFrame, who: str) -> DataFrame:
    located = geo.select(
        F.col("geolocation_zip_code_prefix").alias("_zip"),
        F.col("geolocation_lat").alias(f"{who}_lat"),
        F.col("geolocation_lng").alias(f"{who}_lng"),
        F.col("geolocation_city").alias(f"{who}_geo_city"),
        F.col("geolocation_state").alias(f"{who}_geo_state"),
    )
    return df.join(located, F.col(f"{who}_zip_code_prefix") == F.col("_zip"), "left").drop("_zip")


def customers_enriched(customers: DataFrame, geo: DataFrame) -> DataFrame:
    return _with_geo(customers, geo, "customer")


def sellers_enriched(sellers: DataFrame, geo: DataFrame) -> DataFrame:
    return _with_geo(sellers, geo, "seller")


def payments_agg(payments: DataFrame, layout: Layout = Layout.ANY, buckets: int | None = None) -> DataFrame:
    """Per order: paid total, longest instalment plan, main payment type, number of types."""

    def per_type(df: DataFrame) -> DataFrame:
        return df.groupBy("order_id", "payment_type").agg(
            F.sum("payment_value").alias("_value"),
            F.max("payment_installments").alias("_installments"),
            F.count("*").alias("_n"),
        )

    narrow = payments.select("order_id", "payment_type", "payment_value", "payment_installments")
    return combined_on(narrow, "order_id", per_type, layout, buckets).groupBy("order_id").agg(
        F.sum("_value").alias("payment_value"),
        F.max("_installments").alias("payment_installments"),
        smallest_mode("payment_type", "_n").alias("payment_type"),
        F.count("payment_type").alias("payment_type_nunique"),
    )


def reviews_agg(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("review_score"),
        F.avg(flag(F.col("review_comment_message").isNotNull())).alias("review_comment_rate"),
        F.count_distinct("review_id").alias("review_count"),
    )


def orders_enriched(
    orders: DataFrame, customers_geo: DataFrame, payments: DataFrame, reviews: DataFrame, buckets: int | None = None
) -> DataFrame:
    """Orders with customer, payment and review attributes, one row per order.

    Customers come first: the two pre-aggregated sides share the order_id partitioning, which is that of the
    result; with ``buckets`` it has so many partitions.
    """
    placed = orders.join(customers_geo, "customer_id", "left")
    if buckets:
        placed = placed.repartition(buckets, "order_id")
    return (
        placed.join(payments, "order_id", "left")
        .join(reviews, "order_id", "left")
        .select(
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
            "customer_unique_id",
            "customer_zip_code_prefix",
            "customer_city",
            "customer_state",
            "customer_lat",
            "customer_lng",
            "customer_geo_city",
            "customer_geo_state",
            "payment_value",
            "payment_installments",
            "payment_type",
            "payment_type_nunique",
            "review_score",
            "review_comment_rate",
            "review_count",
        )
    )


def late_flag() -> F.Column:
    """1 only for a delivery after the estimate; undelivered orders count as not late."""
    return flag(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"))


def with_time_features(orders: DataFrame) -> DataFrame:
    return orders.withColumns(
        {
            "delivery_days": days_between("order_purchase_timestamp", "order_delivered_customer_date"),
            "estimated_vs_actual_days": days_between(
                "order_estimated_delivery_date", "order_delivered_customer_date"
            ),
            "approval_lag_hours": hours_between("order_purchase_timestamp", "order_approved_at"),
            "is_late_delivery": late_flag(),
            "purchase_month": month_of("order_purchase_timestamp"),
        }
    )


def order_time_features(enriched_orders: DataFrame) -> DataFrame:
    """Lifecycle features for every order, also those without items."""
    return with_time_features(
        enriched_orders.select(
            "order_id",
            "customer_id",
            "customer_unique_id",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        )
    )
