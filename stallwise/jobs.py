"""Every job by name: its plan on a warehouse and the columns it answers with.

A column spec is ``name:kind``; kinds: ``i`` integer, ``d`` number (6 decimals), ``t`` text,
``date``, ``ts``. The oracle statements use the same specs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans import customers, enrich, experiment, facts, figures, gmv_model, growth, lifetime, logistics
from .plans import marts, quality, strategy, views
from .sources import tables
from .warehouse import Warehouse
from .workspace import new_path

EXACT_LIMIT = 1e9


@dataclass(frozen=True)
class Job:
    plan: Callable[[Warehouse], DataFrame]
    columns: str

    def run(self, wh: Warehouse) -> DataFrame:
        return self.plan(wh).select(*[_shown(*c.split(":")) for c in self.columns.split()])


def _shown(name: str, kind: str) -> Column:
    col = F.col(name)
    if kind == "i":
        return col.cast("bigint").alias(name)
    if kind == "d":
        value = col.cast("double")
        # same arithmetic as the oracle, so halves round alike; beyond the limit six decimals are noise
        rounded = F.floor(value * 1e6 + 0.5).cast("double") / 1e6
        return F.when(F.abs(value) < EXACT_LIMIT, rounded).otherwise(value).alias(name)
    if kind == "t":
        return col.cast("string").alias(name)
    return col.alias(name)


CUSTOMER_GEO = "customer_lat:d customer_lng:d customer_geo_city:t customer_geo_state:t"
ORDER_TIMES = "order_purchase_timestamp:ts order_approved_at:ts order_delivered_customer_date:ts order_estimated_delivery_date:ts"
ORDER_PAID = "payment_value:d payment_installments:i payment_type:t payment_type_nunique:i"
ORDER_REVIEWED = "review_score:d review_comment_rate:d review_count:i"
FEATURES = "delivery_days:d estimated_vs_actual_days:d approval_lag_hours:d is_late_delivery:i purchase_month:date"
ITEM = (
    "order_id:i order_item_id:i product_id:i seller_id:i shipping_limit_date:ts price:d freight_value:d "
    "product_category_name:t product_category_name_english:t product_weight_g:i product_length_cm:i "
    "product_height_cm:i product_width_cm:i seller_zip_code_prefix:i seller_city:t seller_state:t seller_lat:d "
    "seller_lng:d customer_id:i customer_unique_id:i customer_zip_code_prefix:i customer_city:t customer_state:t "
    f"customer_lat:d customer_lng:d order_status:t {ORDER_TIMES} {ORDER_PAID} {ORDER_REVIEWED} "
    "item_gmv:d freight_share:d volume_cm3:i same_state_route:i"
)
ORDER = (
    f"order_id:i customer_unique_id:i customer_state:t order_status:t {ORDER_TIMES} review_score:d payment_value:d "
    "payment_installments:i payment_type:t order_gmv:d freight_gmv:d item_count:i seller_count:i category_count:i "
    f"dominant_category:t avg_distance_km:d {FEATURES} gmv_payment_gap:d"
)
CUSTOMER = (
    "customer_unique_id:i total_gmv:d total_orders:i first_purchase:ts last_purchase:ts avg_order_value:d "
    "avg_review_score:d avg_delivery_days:d late_delivery_rate:d"
)
RFM = f"{CUSTOMER} recency_days:d tenure_days:d purchase_frequency_per_month:d realized_ltv:d repeat_customer:i"
MONTH = "purchase_month:date gmv:d orders:i active_customers:i aov:d"
COHORT = "cohort_month:date cohort_index:i customers:i cohort_size:i retention:d"
CATEGORY = "product_category_name_english:t gmv:d orders:i avg_review:d avg_freight_share:d"
SELLER = "seller_id:i gmv:d orders:i customers:i avg_review:d late_delivery_rate:d"
STATE = "customer_state:t gmv:d orders:i customers:i avg_review:d avg_order_value:d"
FIRST = (
    "customer_unique_id:i order_id:i order_purchase_timestamp:ts order_gmv:d review_score:d estimated_vs_actual_days:d"
)
PEOPLE = f"{FIRST} future_orders:i future_gmv:d baseline_conversion:i"
TREATED = "customer_unique_id:i variant:t baseline_conversion:i uplift_prob:d induced_conversion:i conversion:i"
BASKET = (
    "order_id:i gmv:d item_count:i category_count:i main_category:t avg_weight_g:d avg_volume_cm3:d seller_count:i "
    "main_seller_state:t customer_state:t same_state_share:d payment_installments:i payment_type:t"
)
CURVE = "entity:t entity_rank:i value:d entity_share:d cumulative_share:d"
MATRIX = "cohort_month:date " + " ".join(f"m{i}:d" for i in range(13))
HEATMAP = "cohort:t " + " ".join(f"m{i}:t" for i in range(1, 13))


def _filled_cells(raw) -> DataFrame:
    """Rows and non-null cells per raw table."""
    frames = []
    for name, df in raw.items():
        cells = reduce(lambda a, b: a + b, [F.count(c) for c in df.columns])
        frames.append(
            df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), cells.alias("filled_cells"))
        )
    return reduce(DataFrame.unionByName, frames)


def _ingest(wh: Warehouse) -> DataFrame:
    folder = new_path(wh.raw.orders.sparkSession, "csv")
    tables.write_csv_tables(wh.raw, folder)
    kinds = {name: df.schema for name, df in wh.raw.items()}
    return _filled_cells(tables.ingest_csv(wh.raw.orders.sparkSession, folder, schemas=kinds))


def _append(wh: Warehouse) -> DataFrame:
    """Orders appended in two batches and read back."""
    spark, orders = wh.raw.orders.sparkSession, wh.raw.orders
    path = new_path(spark, "orders-table")
    shipped = F.col("order_status") == "shipped"
    tables.write_table(orders.where(shipped), path)
    tables.write_table(orders.where(~shipped), path)
    stored = spark.read.schema(orders.schema).parquet(path)
    return stored.groupBy("order_status").agg(
        F.count("*").alias("row_count"), F.min("order_id").alias("first_id"), F.max("order_id").alias("last_id")
    )


def _rebuild(wh: Warehouse) -> DataFrame:
    """All tables written, then replaced: the second load must not add to the first."""
    folder = new_path(wh.raw.orders.sparkSession, "tables")
    tables.rebuild_tables(wh.raw, folder)
    return _filled_cells(tables.rebuild_tables(wh.raw, folder))


def _relation(wh: Warehouse) -> DataFrame:
    wh.monthly.createOrReplaceTempView("vw_monthly_metrics")
    return tables.read_relation(
        wh.raw.orders.sparkSession, "SELECT purchase_month, gmv, orders, active_customers, aov FROM vw_monthly_metrics"
    )


def _views(wh: Warehouse) -> DataFrame:
    """Rows behind every registered view."""
    spark = wh.raw.orders.sparkSession
    counts = [
        spark.table(name).agg(F.lit(name).alias("view_name"), F.count("*").alias("row_count"))
        for name in views.register_views(wh)
    ]
    return reduce(DataFrame.unionByName, counts)


def _list_views(wh: Warehouse) -> DataFrame:
    views.register_views(wh)
    return views.list_views(wh.raw.orders.sparkSession)


def _figures(wh: Warehouse) -> DataFrame:
    spark = wh.raw.orders.sparkSession
    stored = figures.export_figures(wh, new_path(spark, "figures"))
    counts = [
        spark.read.parquet(path).agg(
            F.lit(figure).alias("figure"), F.lit(dataset).alias("dataset"), F.count("*").alias("row_count")
        )
        for (figure, dataset), path in stored.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _curves(wh: Warehouse) -> DataFrame:
    parts = [
        wh.curve(e).select(
            F.lit(e).alias("entity"), "entity_rank", F.col("value").cast("double").alias("value"),
            "entity_share", "cumulative_share",
        )
        for e in ("customers", "sellers", "categories")
    ]
    return reduce(DataFrame.unionByName, parts)


def _thresholds(wh: Warehouse) -> DataFrame:
    parts = [
        strategy.pareto_threshold_share(wh.curve(e)).withColumn("entity", F.lit(e))
        for e in ("customers", "sellers", "categories")
    ]
    return reduce(DataFrame.unionByName, parts)


def _scored(wh: Warehouse) -> DataFrame:
    return experiment.uplift_score(experiment.assign(wh.population))


def _fitted(wh: Warehouse, model: object, names: list[str]) -> DataFrame:
    row = tuple(float(getattr(model, n)) for n in names)
    return wh.raw.orders.sparkSession.createDataFrame([row], ", ".join(f"{n} double" for n in names))


JOBS: dict[str, Job] = {
    # sources, sinks, catalog, data quality
    "ingest_csv": Job(_ingest, "table_name:t row_count:i filled_cells:i"),
    "write_table": Job(_append, "order_status:t row_count:i first_id:i last_id:i"),
    "rebuild_tables": Job(_rebuild, "table_name:t row_count:i filled_cells:i"),
    "read_relation": Job(_relation, MONTH),
    "register_views": Job(_views, "view_name:t row_count:i"),
    "list_views": Job(_list_views, "view_name:t"),
    "table_counts": Job(lambda w: quality.table_counts(w.raw), "table_name:t row_count:i"),
    "dq_primary_key": Job(lambda w: quality.primary_key_check(w.raw), "table_name:t dup_groups:i null_keys:i"),
    "dq_foreign_key": Job(
        lambda w: quality.foreign_key_check(w.raw), "child_table:t child_column:t parent_table:t orphans:i"
    ),
    "purchase_coverage": Job(
        lambda w: quality.purchase_coverage(w.raw.orders), "purchase_start:date purchase_end:date"
    ),
    "chart_export": Job(_figures, "figure:t dataset:t row_count:i"),
    # enrichment, from the raw tables
    "products_enriched": Job(
        Warehouse.products_plan,
        "product_id:i product_category_name:t product_category_name_english:t product_name_lenght:i "
        "product_description_lenght:i product_photos_qty:i product_weight_g:i product_length_cm:i "
        "product_height_cm:i product_width_cm:i",
    ),
    "geo_zip": Job(
        Warehouse.geo_zip_plan,
        "geolocation_zip_code_prefix:i geolocation_lat:d geolocation_lng:d geolocation_city:t geolocation_state:t",
    ),
    "customers_enriched": Job(
        Warehouse.customers_plan,
        "customer_id:i customer_unique_id:i customer_zip_code_prefix:i customer_city:t customer_state:t "
        + CUSTOMER_GEO,
    ),
    "sellers_enriched": Job(
        Warehouse.sellers_plan,
        "seller_id:i seller_zip_code_prefix:i seller_city:t seller_state:t seller_lat:d seller_lng:d "
        "seller_geo_city:t seller_geo_state:t",
    ),
    "payments_agg": Job(Warehouse.payments_plan, f"order_id:i {ORDER_PAID}"),
    "reviews_agg": Job(lambda w: enrich.reviews_agg(w.raw.order_reviews), f"order_id:i {ORDER_REVIEWED}"),
    "orders_enriched": Job(
        Warehouse.orders_plan,
        f"order_id:i customer_id:i order_status:t {ORDER_TIMES} order_delivered_carrier_date:ts "
        f"customer_unique_id:i customer_zip_code_prefix:i customer_city:t customer_state:t {CUSTOMER_GEO} "
        f"{ORDER_PAID} {ORDER_REVIEWED}",
    ),
    # facts
    "order_item_base": Job(lambda w: w.item_plan().drop("distance_km"), ITEM),
    "order_item_geo": Job(lambda w: w.item_plan(), f"{ITEM} distance_km:d"),
    "order_time_features": Job(
        lambda w: enrich.order_time_features(w.orders_plan()),
        f"order_id:i customer_id:i customer_unique_id:i order_status:t {ORDER_TIMES} {FEATURES}",
    ),
    "order_level": Job(Warehouse.order_plan, ORDER),
    "completed_orders": Job(lambda w: w.completed_orders, ORDER),
    "delivered_orders": Job(lambda w: w.delivered_orders, ORDER),
    "completed_items": Job(lambda w: w.completed_items, f"{ITEM} distance_km:d"),
    "delivered_items": Job(lambda w: facts.delivered(w.item_fact), f"{ITEM} distance_km:d"),
    "completed_orders_summary": Job(
        lambda w: facts.completed_orders_summary(w.completed_orders), "completed_orders:i total_gmv:d avg_order_gmv:d"
    ),
    "fact_preview": Job(
        lambda w: facts.item_preview(w.item_fact),
        "order_id:i product_category_name_english:t item_gmv:d freight_share:d volume_cm3:d same_state_route:i",
    ),
    "fact_preview_distance": Job(
        lambda w: facts.distance_preview(w.item_fact), "order_id:i customer_state:t seller_state:t distance_km:d"
    ),
    "fact_preview_orders": Job(
        lambda w: facts.order_preview(w.completed_orders),
        "order_id:i customer_state:t order_status:t order_gmv:d delivery_days:d is_late_delivery:i "
        "avg_distance_km:d dominant_category:t",
    ),
    "fact_preview_customers": Job(
        lambda w: facts.customer_preview(w.customer_level),
        "customer_unique_id:i total_orders:i total_gmv:d avg_order_value:d recency_days:d "
        "purchase_frequency_per_month:d repeat_customer:i value_segment:t",
    ),
    # customers
    "customer_agg": Job(lambda w: customers.customer_agg(w.completed_orders), CUSTOMER),
    "customer_rfm": Job(lambda w: customers.customer_rfm(w.customer_agg), RFM),
    "customer_level": Job(lambda w: w.customer_level, f"{RFM} value_quartile:i value_segment:t"),
    "repeat_customer_rate": Job(
        lambda w: customers.repeat_customer_rate(customers.customer_rfm(w.customer_agg)), "repeat_customer_rate:d"
    ),
    "ltv_segment_summary": Job(
        lambda w: customers.ltv_segment_summary(w.customer_level),
        "segment_rank:i value_segment:t customers:i gmv:d avg_orders:d avg_review:d avg_recency_days:d gmv_share:d",
    ),
    "ltv_quantiles": Job(
        lambda w: customers.ltv_quantiles(customers.customer_rfm(w.customer_agg)),
        "median_ltv:d p90_ltv:d p99_ltv:d",
    ),
    "ltv_histogram": Job(
        lambda w: customers.ltv_histogram(customers.customer_rfm(w.customer_agg)),
        "bin:i bin_start:d bin_end:d customers:i",
    ),
    "high_segment_share": Job(
        lambda w: customers.high_segment_share(customers.ltv_segment_summary(w.customer_level)),
        "high_segment_share:d",
    ),
    # growth, mix, cohorts
    "monthly_metrics": Job(lambda w: w.monthly, MONTH),
    "monthly_metrics_full": Job(lambda w: growth.monthly_metrics_full(w.monthly, 100), MONTH),
    "growth_summary": Job(
        lambda w: growth.growth_summary(w.monthly),
        "peak_month:date peak_gmv:d first_month:date first_gmv:d last_month:date last_gmv:d gmv_growth:d",
    ),
    "order_sequence": Job(
        lambda w: growth.order_sequence(w.completed_orders),
        "order_id:i customer_unique_id:i purchase_month:date order_purchase_timestamp:ts order_rank:i "
        "is_new_order:i is_repeat_order:i",
    ),
    "monthly_customer_mix": Job(
        lambda w: w.customer_mix,
        "purchase_month:date active_customers:i new_customers:i repeat_orders:i total_orders:i "
        "returning_customer_proxy:i repeat_order_share:d",
    ),
    "avg_repeat_share": Job(lambda w: growth.avg_repeat_share(w.customer_mix), "avg_repeat_share:d"),
    "cohort_activity": Job(
        lambda w: growth.cohort_activity(w.completed_orders, w.customer_agg),
        "customer_unique_id:i order_id:i cohort_month:date order_month:date cohort_index:i",
    ),
    "cohort_retention": Job(lambda w: w.retention, COHORT),
    "cohort_check": Job(lambda w: growth.cohort_check(w.retention), COHORT),
    "cohort_matrix": Job(lambda w: growth.cohort_matrix(w.retention), MATRIX),
    "cohort_heatmap": Job(lambda w: growth.cohort_heatmap(w.retention), HEATMAP),
    "avg_retention": Job(lambda w: growth.avg_retention(w.retention), "avg_retention_m1:d avg_retention_m3:d"),
    # marts
    "category_summary": Job(lambda w: marts.category_summary(w.completed_items), CATEGORY),
    "top_categories": Job(lambda w: marts.top_categories(w.category_summary), CATEGORY),
    "category_scatter": Job(lambda w: marts.category_scatter(w.category_summary), CATEGORY),
    "fix_categories": Job(lambda w: marts.fix_categories(w.category_summary), CATEGORY),
    "seller_summary": Job(
        lambda w: marts.seller_summary(w.seller_base), f"{SELLER} seller_rank:i cumulative_gmv_share:d"
    ),
    "top_sellers": Job(lambda w: marts.top_sellers(w.seller_base), SELLER),
    "seller_topk_share": Job(lambda w: marts.seller_topk_share(w.seller_summary), "top10_share:d top50_share:d"),
    "risky_sellers": Job(lambda w: marts.risky_sellers(w.seller_base), SELLER),
    "seller_pareto_curve": Job(
        lambda w: marts.seller_pareto_curve(w.seller_summary),
        "seller_id:i seller_rank:i seller_percentile:d cumulative_gmv_share:d",
    ),
    "seller_scatter": Job(lambda w: marts.seller_scatter(w.seller_base), SELLER),
    "state_summary": Job(lambda w: marts.state_summary(w.completed_orders), STATE),
    "top_states": Job(lambda w: marts.top_states(marts.state_summary(w.completed_orders)), STATE),
    "route_summary": Job(
        lambda w: marts.route_summary(w.completed_items),
        "route_type:t items:i gmv:d avg_freight:d avg_review:d gmv_share:d",
    ),
    "distance_summary": Job(
        lambda w: marts.distance_summary(w.completed_items),
        "distance_bucket:i avg_distance_km:d avg_freight:d avg_review:d",
    ),
    # logistics
    "review_distribution": Job(
        lambda w: logistics.review_distribution(w.delivered_orders), "review_score_rounded:i orders:i"
    ),
    "review_by_lateness": Job(
        lambda w: logistics.review_by_lateness(w.delivered_orders), "delivery_status:t orders:i avg_review:d"
    ),
    "review_box_stats": Job(
        lambda w: logistics.review_box_stats(w.delivered_orders),
        "delivery_status:t q1:d median:d q3:d whisker_low:d whisker_high:d",
    ),
    # lifetime value
    "ltv_transactions": Job(
        lambda w: lifetime.ltv_transactions(w.delivered_orders),
        "customer_unique_id:i order_purchase_timestamp:ts order_gmv:d",
    ),
    "rft_summary": Job(
        Warehouse.rft_plan,
        "customer_unique_id:i frequency:i recency:d T:d monetary_value:d",
    ),
    "bgnbd_fit": Job(
        lambda w: _fitted(w, w.purchase_model, ["r", "alpha", "a", "b", "objective"]),
        "r:d alpha:d a:d b:d objective:d",
    ),
    "gamma_gamma_fit": Job(
        lambda w: _fitted(w, w.spend_model, ["p", "q", "v", "objective"]), "p:d q:d v:d objective:d"
    ),
    "predicted_purchases_180d": Job(
        lambda w: lifetime.predict(w.rft, w.purchase_model),
        "customer_unique_id:i frequency:i recency:d T:d predicted_6m_purchases:d",
    ),
    "predicted_ltv_6m": Job(
        lambda w: w.predictions, "customer_unique_id:i monetary_value:d predicted_6m_purchases:d predicted_6m_ltv:d"
    ),
    "ltv_describe": Job(
        lambda w: lifetime.ltv_describe(w.predictions),
        "statistic:t frequency:d monetary_value:d predicted_6m_purchases:d predicted_6m_ltv:d",
    ),
    # experiment
    "exp_first_orders": Job(lambda w: experiment.first_orders(w.completed_orders), FIRST),
    "exp_eligible": Job(
        lambda w: experiment.eligible(experiment.first_orders(w.completed_orders), w.cutoff), FIRST
    ),
    "exp_outcomes": Job(
        lambda w: experiment.outcomes(w.completed_orders, w.cutoff),
        "customer_unique_id:i future_orders:i future_gmv:d",
    ),
    "exp_population": Job(lambda w: w.population, PEOPLE),
    "exp_assign": Job(lambda w: experiment.assign(w.population), "customer_unique_id:i variant:t"),
    "exp_uplift_score": Job(_scored, "customer_unique_id:i variant:t uplift_prob:d"),
    "exp_induced": Job(lambda w: experiment.induced(_scored(w)), TREATED),
    "exp_financials": Job(
        lambda w: w.experiment,
        "customer_unique_id:i variant:t conversion:i gross_gmv_without_discount:d net_gmv:d discount_cost:d",
    ),
    "exp_summary": Job(
        lambda w: experiment.summary(w.experiment),
        "variant:t users:i conversion_rate:d conversion_rate_pct:d gmv_per_user:d discount_cost_per_user:d",
    ),
    "exp_welch_test": Job(
        lambda w: experiment.welch_test(w.experiment), "metric:t t_statistic:d degrees_of_freedom:d"
    ),
    "exp_welch_p": Job(
        lambda w: experiment.welch_p_values(experiment.welch_test(w.experiment)),
        "metric:t t_statistic:d degrees_of_freedom:d p_value:d",
    ),
    "exp_uplift": Job(
        lambda w: experiment.uplift(experiment.summary(w.experiment)), "conversion_uplift_pp:d gmv_per_user_uplift:d"
    ),
    # concentration and strategy
    "pareto_curve": Job(_curves, CURVE),
    "pareto_threshold_share": Job(_thresholds, "entity:t threshold_share:d"),
    "segment_category_mix": Job(
        lambda w: w.segment_mix,
        "value_segment:t product_category_name_english:t gmv:d category_rank:i mix_share:d",
    ),
    "mix_compare": Job(
        lambda w: strategy.mix_compare(w.segment_mix), "product_category_name_english:t high_value:d low_value:d"
    ),
    "category_strategy": Job(
        lambda w: strategy.category_strategy(w.category_summary),
        "product_category_name_english:t gmv:d avg_review:d avg_freight_share:d strategic_action:t",
    ),
    "strategy_display": Job(
        lambda w: strategy.strategy_display(strategy.category_strategy(w.category_summary)),
        "strategic_action:t action_rank:i product_category_name_english:t gmv:d avg_review:d avg_freight_share:d",
    ),
    # order-value model
    "model_items": Job(
        lambda w: w.model_items,
        "order_id:i order_item_id:i customer_state:t seller_state:t product_category_name_english:t item_gmv:d "
        "product_weight_g:i volume_cm3:i seller_id:i same_state_route:i payment_installments:i payment_type:t",
    ),
    "top_n_or_other": Job(
        lambda w: gmv_model.top_values(w.model_items), "feature:t value:t row_count:i"
    ),
    "payment_type_map": Job(
        lambda w: w.grouped_items,
        "order_id:i order_item_id:i seller_id:i category_group:t customer_state_group:t seller_state_group:t "
        "payment_type:t",
    ),
    "model_orders": Job(Warehouse.model_orders_plan, BASKET),
    "model_sample_split": Job(lambda w: w.model_sample, f"{BASKET} is_test:t label:d"),
    "model_fit": Job(
        lambda w: gmv_model.describe_fit(w.model, w.model_sample),
        "sampled_orders:i train_orders:i test_orders:i trees:i total_nodes:i features:i",
    ),
    "model_score": Job(lambda w: w.model_scored, "order_id:i actual:d predicted:d"),
    "model_metrics": Job(
        lambda w: gmv_model.model_metrics(w.model_scored, w.model_sample.count()), "metric:t value:d"
    ),
    "feature_importance": Job(
        lambda w: gmv_model.feature_importance(w.model, w.model_sample), "feature_group:t importance:d"
    ),
    "pred_vs_actual_sample": Job(
        lambda w: gmv_model.pred_vs_actual_sample(w.model_scored), "order_id:i actual:d predicted:d axis_limit:d"
    ),
}
