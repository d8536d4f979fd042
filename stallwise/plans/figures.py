"""Datasets behind the twelve dashboard figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..warehouse import Warehouse
from . import customers, experiment, gmv_model, growth, logistics, marts, strategy


def figure_plans(wh: Warehouse) -> dict[tuple[str, str], Callable[[], DataFrame]]:
    """(figure, dataset) -> plan."""
    # The names of the figures.
    return {
        ("monthly_growth_kpis", "trend"): lambda: growth.monthly_metrics_full(wh.monthly, 100),
        ("customer_acquisition_vs_repeat_behavior", "mix"): lambda: growth.without_last_month(wh.customer_mix),
        ("category_scale_satisfaction", "top"): lambda: marts.top_categories(wh.category_summary),
        ("category_scale_satisfaction", "scatter"): lambda: marts.category_scatter(wh.category_summary),
        ("seller_concentration_quality", "curve"): lambda: marts.seller_pareto_curve(wh.seller_summary),
        ("seller_concentration_quality", "scatter"): lambda: marts.seller_scatter(wh.seller_base),
        ("logistics_satisfaction_patterns", "scores"): lambda: logistics.review_distribution(wh.delivered_orders),
        ("logistics_satisfaction_patterns", "box"): lambda: logistics.review_box_stats(wh.delivered_orders),
        ("logistics_satisfaction_patterns", "distance"): lambda: wh.distance_summary,
        ("regional_gmv_route_economics", "states"): lambda: marts.top_states(marts.state_summary(wh.completed_orders)),
        ("regional_gmv_route_economics", "routes"): lambda: marts.route_summary(wh.completed_items),
        ("cohort_retention", "matrix"): lambda: growth.cohort_matrix(wh.retention),
        ("customer_ltv_distribution_segments", "bins"): lambda: customers.ltv_histogram(wh.customer_level),
        ("customer_ltv_distribution_segments", "segments"): lambda: customers.ltv_segment_summary(wh.customer_level),
        ("ab_test_results", "summary"): lambda: experiment.summary(wh.experiment),
        ("marketplace_value_concentration", "customers"): lambda: wh.curve("customers"),
        ("marketplace_value_concentration", "sellers"): lambda: wh.curve("sellers"),
        ("marketplace_value_concentration", "categories"): lambda: wh.curve("categories"),
        ("category_strategy_by_value_segment", "actions"): lambda: strategy.strategy_display(
            strategy.category_strategy(wh.category_summary)
        ),
        ("category_strategy_by_value_segment", "mix"): lambda: strategy.mix_compare(wh.segment_mix),
        ("predictive_modeling", "points"): lambda: gmv_model.pred_vs_actual_sample(wh.model_scored),
        ("predictive_modeling", "importance"): lambda: gmv_model.feature_importance(wh.model, wh.model_sample, 10),
    }


def export_figures(wh: Warehouse, folder: str) -> dict[tuple[str, str], str]:
    """Write every dataset as Parquet under ``folder`` and return where each one is."""
    # the datasets need items and orders; orders are then built from the written items
    _ = wh.item_fact
    written = {}
    for (figure, dataset), plan in figure_plans(wh).items():
        path = f"{folder}/{figure}/{dataset}"
        plan().write.mode("overwrite").parquet(path)
        written[(figure, dataset)] = path
    return written
