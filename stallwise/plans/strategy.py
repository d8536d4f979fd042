"""Value concentration, segment mixes and category strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators.cuts import exact_quantiles
from ..operators.grouping import Layout, combined_on
from ..operators.running import with_running
from .marts import CATEGORY


def pareto_curve(df: DataFrame, entity: str, value: str, **options) -> DataFrame:
    """Cumulative value share against entity share, largest value first (ties by entity)."""
    values = df.where(F.col(value).isNotNull()).select(
        F.col(entity).alias("entity_id"), F.col(value).alias("value")
    )
    ranked = with_running(
        values,
        order=[F.col("value").desc(), F.col("entity_id").asc_nulls_last()],
        rank="entity_rank",
        total="value",
        running="_running",
        **options,
    )
    whole = values.agg(F.struct(F.count("*").alias("n"), F.sum("value").alias("total"))).scalar()
    return ranked.withColumn("_w", whole).select(
        "entity_id",
        "value",
        "entity_rank",
        ratio(F.col("entity_rank"), F.col("_w.n")).alias("entity_share"),
        ratio(F.col("_running"), F.col("_w.total")).alias("cumulative_share"),
    )


def pareto_threshold_share(curve: DataFrame, target: float = 0.80) -> DataFrame:
    """Share of entities needed to reach the target share of the value."""
    within = F.count(F.when(F.col("cumulative_share") <= target, True))
    return curve.agg(ratio(within + 1, F.count("*")).alias("threshold_share"))


def segment_category_mix(
    completed_items: DataFrame,
    customers: DataFrame,
    segments: tuple[str, ...] = ("High", "Low"),
    top: int = 8,
    layout: Layout = Layout.ANY,
) -> DataFrame:
    """Top categories per value segment with their share inside the top list.

    Items are summed per customer and category before the join, so a hot customer is a handful
    of rows by the time it is shuffled.
    """

    def per_category(items: DataFrame) -> DataFrame:
        return items.groupBy("customer_unique_id", CATEGORY).agg(F.sum("item_gmv").alias("gmv"))

    usable = completed_items.where(F.col("customer_unique_id").isNotNull() & F.col(CATEGORY).isNotNull())
    narrow = usable.select("customer_unique_id", CATEGORY, "item_gmv")
    spend = combined_on(narrow, "customer_unique_id", per_category, layout)
    members = customers.where(F.col("value_segment").isin(*segments)).select("customer_unique_id", "value_segment")
    totals = spend.join(members, "customer_unique_id").groupBy("value_segment", CATEGORY).agg(F.sum("gmv").alias("gmv"))
    best = Window.partitionBy("value_segment").orderBy(F.col("gmv").desc_nulls_last(), CATEGORY)
    ranked = totals.withColumn("category_rank", F.row_number().over(best)).where(F.col("category_rank") <= top)
    return ranked.withColumn(
        "mix_share", ratio(F.col("gmv"), F.sum("gmv").over(Window.partitionBy("value_segment")))
    )


def mix_compare(mix: DataFrame, high: str = "High", low: str = "Low") -> DataFrame:
    def side(segment: str, name: str) -> DataFrame:
        return mix.where(F.col("value_segment") == segment).select(CATEGORY, F.col("mix_share").alias(name))

    return (
        side(high, "high_value")
        .join(side(low, "low_value"), CATEGORY, "full_outer")
        .fillna(0.0, ["high_value", "low_value"])
        .orderBy("high_value", CATEGORY)
    )


def category_strategy(categories: DataFrame) -> DataFrame:
    """Ordered rules on the full category table; a category without reviews is maintained."""
    gmv_low, gmv_high = exact_quantiles(categories, "gmv", [0.25, 0.75])
    (review_cut,) = exact_quantiles(categories, "avg_review", [0.5])
    gmv, review = F.col("gmv").cast("double"), F.col("avg_review")
    big, small = gmv >= F.lit(gmv_high), gmv <= F.lit(gmv_low)
    liked, disliked = review >= F.lit(review_cut), review < F.lit(review_cut)
    action = (
        F.when(big & liked, "Invest")
        .when(big & disliked, "Fix")
        .when(small & disliked, "Rationalize / Monitor")
        .otherwise("Maintain")
    )
    return categories.select(CATEGORY, "gmv", "avg_review", "avg_freight_share", action.alias("strategic_action"))


def strategy_display(strategy: DataFrame, per_action: int = 5) -> DataFrame:
    best = Window.partitionBy("strategic_action").orderBy(F.col("gmv").desc(), CATEGORY)
    return (
        strategy.where(F.col("strategic_action") != "Maintain")
        .withColumn("action_rank", F.row_number().over(best))
        .where(F.col("action_rank") <= per_action)
        .orderBy("strategic_action", "action_rank")
    )
