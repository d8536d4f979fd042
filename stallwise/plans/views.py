"""The named views of the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..warehouse import Warehouse
from . import enrich, facts, marts


def view_plans(wh: Warehouse) -> dict[str, DataFrame]:
    """The 23 views in dependency order; item and order level views read the written facts."""
    # The names of the views.
    return {
        "vw_products_enriched": wh.products_plan(),
        "vw_geo_zip": wh.geo_zip_plan(),
        "vw_customers_enriched": wh.customers_plan(),
        "vw_sellers_enriched": wh.sellers_plan(),
        "vw_payments_agg": wh.payments_plan(),
        "vw_reviews_agg": enrich.reviews_agg(wh.raw.order_reviews),
        "vw_orders_enriched": wh.orders_enriched,
        "vw_order_item_base": wh.item_fact.drop("distance_km"),
        "vw_order_item_geo": wh.item_fact,
        "vw_order_level": wh.order_fact,
        "vw_completed_orders": wh.completed_orders,
        "vw_delivered_orders": wh.delivered_orders,
        "vw_completed_items": wh.completed_items,
        "vw_delivered_items": facts.delivered(wh.item_fact),
        "vw_customer_level": wh.customer_level,
        "vw_monthly_metrics": wh.monthly,
        "vw_monthly_customer_mix": wh.customer_mix,
        "vw_category_summary": wh.category_summary,
        "vw_seller_summary": wh.seller_summary,
        "vw_state_summary": marts.state_summary(wh.completed_orders),
        "vw_route_summary": marts.route_summary(wh.completed_items),
        "vw_distance_summary": wh.distance_summary,
        "vw_cohort_retention": wh.retention,
    }


def register_views(wh: Warehouse) -> list[str]:
    plans = view_plans(wh)
    for name, df in plans.items():
        df.createOrReplaceTempView(name)
    return list(plans)


def list_views(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW VIEWS LIKE 'vw_*'").selectExpr("viewName AS view_name").orderBy("view_name")
