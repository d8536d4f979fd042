"""Discount experiment: population, assignment, simulated uplift, financial readout, tests."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import flag, hash_unit, month_of, ratio
from ..functions.student import two_sided_p
from ..operators.cuts import exact_quantiles

# The experiment's design.
CUTOFF = datetime(2018, 3, 1)
WINDOW_DAYS = 90
DISCOUNT_KEEPS = 0.90
BASE_UPLIFT = 0.0005
REVIEW_UPLIFT, GOOD_REVIEW, REVIEW_FILL = 0.0010, 4, 4
VALUE_UPLIFT = 0.0008
DELIVERY_UPLIFT, DELIVERY_FILL = 0.0007, -5
TREATMENT_SHARE = 0.5
CUSTOMER = "customer_unique_id"
TS = "order_purchase_timestamp"


def _timestamp(value: datetime) -> F.Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast(T.TimestampNTZType())


def _usable(completed_orders: DataFrame) -> DataFrame:
    needed = F.col(CUSTOMER).isNotNull() & F.col(TS).isNotNull() & F.col("order_gmv").isNotNull()
    return completed_orders.where(needed)


def first_orders(completed_orders: DataFrame) -> DataFrame:
    """Earliest order per customer; a missing review or delivery delay is taken from the next
    order that has one (first non-null value per column)."""
    when = F.struct(TS, "order_id")

    def first_known(name: str) -> F.Column:
        # min over (position, value) of the rows that have a value
        return F.min(F.when(F.col(name).isNotNull(), F.struct(TS, "order_id", name)))[name].alias(name)

    return (
        _usable(completed_orders)
        .groupBy(CUSTOMER)
        .agg(
            F.min_by(F.struct("order_id", TS, "order_gmv"), when).alias("_first"),
            first_known("review_score"),
            first_known("estimated_vs_actual_days"),
        )
        .select(CUSTOMER, "_first.*", "review_score", "estimated_vs_actual_days")
    )


def eligible(firsts: DataFrame, cutoff: datetime = CUTOFF) -> DataFrame:
    return firsts.where(F.col(TS) < _timestamp(cutoff))


def outcomes(completed_orders: DataFrame, cutoff: datetime = CUTOFF, days: int = WINDOW_DAYS) -> DataFrame:
    """Orders in the half-open window after the cutoff; only the months that it touches are read."""
    start = _timestamp(cutoff)
    end = start + F.make_dt_interval(F.lit(days))
    return (
        _usable(completed_orders)
        .where(F.col("purchase_month").between(month_of(start), month_of(end)))
        .where((F.col(TS) >= start) & (F.col(TS) < end))
        .groupBy(CUSTOMER)
        .agg(F.count("order_id").alias("future_orders"), F.sum("order_gmv").alias("future_gmv"))
    )


def population(eligible_customers: DataFrame, future: DataFrame) -> DataFrame:
    joined = eligible_customers.join(future, CUSTOMER, "left").withColumns(
        {
            "future_orders": F.coalesce("future_orders", F.lit(0)),
            "future_gmv": F.coalesce("future_gmv", F.lit(0)),
        }
    )
    return joined.withColumn("baseline_conversion", flag(F.col("future_orders") > 0))


def assign(people: DataFrame, salt: str = "variant-42") -> DataFrame:
    """Stable 50/50 split: the variant depends on the customer id and the salt only."""
    draw = hash_unit(salt, CUSTOMER)
    return people.withColumn("variant", F.when(draw < TREATMENT_SHARE, "control").otherwise("treatment"))


def uplift_score(people: DataFrame) -> DataFrame:
    """``people`` should be a written table: its exact median order value is needed first."""
    (median,) = exact_quantiles(people, "order_gmv", [0.5])
    review = F.coalesce("review_score", F.lit(REVIEW_FILL)) >= GOOD_REVIEW
    valuable = F.col("order_gmv").cast("double") >= F.lit(median)
    punctual = F.coalesce("estimated_vs_actual_days", F.lit(DELIVERY_FILL)) <= 0
    score = (
        F.lit(BASE_UPLIFT)
        + F.lit(REVIEW_UPLIFT) * flag(review)
        + F.lit(VALUE_UPLIFT) * flag(valuable)
        + F.lit(DELIVERY_UPLIFT) * flag(punctual)
    )
    return people.withColumn("uplift_prob", score)


def induced(scored: DataFrame, salt: str = "induced-42") -> DataFrame:
    """Second salted draw decides which treated non-converters the discount wins."""
    won = (
        (F.col("variant") == "treatment")
        & (F.col("baseline_conversion") == 0)
        & (hash_unit(salt, CUSTOMER) < F.col("uplift_prob"))
    )
    return scored.withColumn("induced_conversion", flag(won)).withColumn(
        "conversion", F.greatest("baseline_conversion", "induced_conversion")
    )


def financials(converted: DataFrame) -> DataFrame:
    """Induced buyers spend their first order's value; treated customers get the discount on
    baseline orders too."""
    future, first = F.col("future_gmv").cast("double"), F.col("order_gmv").cast("double")
    won, treated = F.col("induced_conversion") == 1, F.col("variant") == "treatment"
    gross = future + F.when(won, first).otherwise(F.lit(0.0))
    net = F.when(won, first * DISCOUNT_KEEPS).when(treated, future * DISCOUNT_KEEPS).otherwise(future)
    return converted.withColumns({"gross_gmv_without_discount": gross, "net_gmv": net}).withColumn(
        "discount_cost",
        F.when(treated, F.col("gross_gmv_without_discount") - F.col("net_gmv")).otherwise(F.lit(0.0)),
    )


def summary(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("variant")
        .agg(
            F.count(CUSTOMER).alias("users"),
            F.avg("conversion").alias("conversion_rate"),
            F.avg("net_gmv").alias("gmv_per_user"),
            F.avg("discount_cost").alias("discount_cost_per_user"),
        )
        .withColumn("conversion_rate_pct", F.col("conversion_rate") * 100)
    )


def welch_test(results: DataFrame, metrics: tuple[str, ...] = ("conversion", "net_gmv")) -> DataFrame:
    """Welch's t and degrees of freedom as columns over one aggregate; p on the result rows."""
    moments = []
    for m in metrics:
        for variant, tag in (("treatment", "t"), ("control", "c")):
            value = F.when(F.col("variant") == variant, F.col(m).cast("double"))
            value = F.when(~F.isnan(value), value)
            moments += [
                F.count(value).cast("double").alias(f"{m}_{tag}_n"),
                F.avg(value).alias(f"{m}_{tag}_mean"),
                F.var_samp(value).alias(f"{m}_{tag}_var"),
            ]
    one_row = results.agg(*moments)
    tests = [
        F.struct(
            F.lit(m).alias("metric"),
            *[F.col(f"{m}_{tag}_{part}").alias(f"{tag}_{part}") for tag in "tc" for part in ("n", "mean", "var")],
        )
        for m in metrics
    ]
    rows = one_row.select(F.inline(F.array(*tests)))
    error_t, error_c = ratio(F.col("t_var"), F.col("t_n")), ratio(F.col("c_var"), F.col("c_n"))
    both = error_t + error_c
    degrees = ratio(
        both * both,
        ratio(error_t * error_t, F.col("t_n") - 1) + ratio(error_c * error_c, F.col("c_n") - 1),
    )
    statistics = rows.select(
        "metric",
        ratio(F.col("t_mean") - F.col("c_mean"), F.sqrt(both)).alias("t_statistic"),
        degrees.alias("degrees_of_freedom"),
    )
    return statistics


def welch_p_values(tests: DataFrame) -> DataFrame:
    """Add two-sided p-values; ``tests`` has one row per metric."""
    schema = T.StructType([*tests.schema.fields, T.StructField("p_value", T.DoubleType())])

    def add(batches):
        for batch in batches:
            pairs = zip(batch["t_statistic"], batch["degrees_of_freedom"])
            yield batch.assign(
                p_value=[None if t is None or math.isnan(t) else two_sided_p(t, df) for t, df in pairs]
            )

    return tests.mapInPandas(add, schema)


def uplift(experiment_summary: DataFrame) -> DataFrame:
    def of(variant: str, column: str) -> F.Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    return experiment_summary.agg(
        ((of("treatment", "conversion_rate") - of("control", "conversion_rate")) * 100).alias("conversion_uplift_pp"),
        (of("treatment", "gmv_per_user") - of("control", "gmv_per_user")).alias("gmv_per_user_uplift"),
    )
