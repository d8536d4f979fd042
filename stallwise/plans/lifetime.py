"""Probabilistic lifetime value: BG/NBD purchase model and Gamma-Gamma spend model.

The likelihoods are sums over a written table of distinct observations with weights. Each
scoring pass is one Spark job that evaluates a batch of parameter vectors per Arrow batch and
returns one partial sum per partition and vector; the driver only steps four or three numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.newton import minimise
from ..functions.scalars import ratio
from ..functions.special import hypergeometric, log_beta, log_gamma
from ..operators.cuts import exact_quantiles
from ..operators.grouping import Layout, combined_on

CUSTOMER = "customer_unique_id"
TS = "order_purchase_timestamp"
# Penalty on the squared parameters, horizon, months, days per month, discount.
PENALTY = 0.01
HORIZON_DAYS = 180
MONTHS, DAYS_PER_STEP, DISCOUNT_RATE = 6, 30, 0.01
# time is rescaled so that the longest observation is this long while fitting
SCALED_AGE = 10.0


@dataclass(frozen=True)
class PurchaseModel:
    """BG/NBD parameters; ``alpha`` is in days."""

    r: float
    alpha: float
    a: float
    b: float
    objective: float
    iterations: int


@dataclass(frozen=True)
class SpendModel:
    """Gamma-Gamma parameters."""

    p: float
    q: float
    v: float
    objective: float
    iterations: int


def ltv_transactions(delivered_orders: DataFrame) -> DataFrame:
    usable = F.col(CUSTOMER).isNotNull() & F.col(TS).isNotNull() & (F.col("order_gmv") > 0)
    return delivered_orders.where(usable).select(CUSTOMER, TS, "order_gmv")


def rft_summary(transactions: DataFrame, layout: Layout = Layout.ANY) -> DataFrame:
    """Frequency, recency, age (in days) and mean spend over repeat days per customer."""

    def per_day(df: DataFrame) -> DataFrame:
        return df.groupBy(CUSTOMER, F.to_date(TS).alias("_day")).agg(F.sum("order_gmv").alias("_spend"))

    daily = combined_on(transactions, CUSTOMER, per_day, layout)
    last_day = transactions.agg(F.to_date(F.max(TS))).scalar()
    per_customer = daily.groupBy(CUSTOMER).agg(
        (F.count("*") - 1).alias("frequency"),
        F.min("_day").alias("_first"),
        F.max("_day").alias("_last"),
        F.sum("_spend").alias("_total"),
        F.min_by("_spend", "_day").alias("_first_spend"),
    )
    repeat_spend = ratio(F.col("_total") - F.col("_first_spend"), F.col("frequency"))
    return per_customer.select(
        CUSTOMER,
        "frequency",
        F.date_diff("_last", "_first").cast("double").alias("recency"),
        F.date_diff(last_day, F.col("_first")).cast("double").alias("T"),
        F.coalesce(repeat_spend, F.lit(0.0)).alias("monetary_value"),
    )


def purchase_observations(rft: DataFrame) -> DataFrame:
    return rft.groupBy("frequency", "recency", "T").agg(F.count("*").cast("double").alias("weight"))


def spend_observations(rft: DataFrame) -> DataFrame:
    repeat = rft.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    return repeat.groupBy("frequency", "monetary_value").agg(F.count("*").cast("double").alias("weight"))


def purchase_log_likelihood(x, tx, age, theta) -> np.ndarray:
    """BG/NBD log-likelihood: still active at the end, or dropped out at the last purchase."""
    r, alpha, a, b = theta
    common = log_gamma(r + x) - log_gamma(r) + r * np.log(alpha) - log_beta(a, b)
    active = log_beta(a, b + x) - (r + x) * np.log(alpha + age)
    # the drop-out branch exists only after a repeat purchase
    repeat = x > 0
    dropped = log_beta(a + 1.0, b + np.where(repeat, x, 1.0) - 1.0) - (r + x) * np.log(alpha + tx)
    return common + np.logaddexp(active, np.where(repeat, dropped, -np.inf))


def spend_log_likelihood(x, m, theta) -> np.ndarray:
    p, q, v = theta
    shape = p * x
    return (
        -log_beta(shape, q) + q * np.log(v) + (shape - 1) * np.log(m) + shape * np.log(x) - (shape + q) * np.log(x * m + v)
    )


def _scorer(
    observations: DataFrame, columns: list[str], log_likelihood: Callable, weight: float
) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Penalised mean negative log-likelihood of a batch of log-parameter vectors, in one job."""
    narrow = observations.select(*columns, "weight")

    def score(points: list[np.ndarray]) -> np.ndarray:
        thetas = [np.exp(p) for p in points]

        def partial(batches):
            sums = np.zeros(len(thetas))
            for batch in batches:
                values = [batch[c].to_numpy(dtype=float) for c in columns]
                weights = batch["weight"].to_numpy(dtype=float)
                for i, theta in enumerate(thetas):
                    sums[i] += np.dot(weights, log_likelihood(*values, theta))
            yield pd.DataFrame({"candidate": range(len(sums)), "total": sums})

        rows = (
            narrow.mapInPandas(partial, "candidate int, total double")
            .groupBy("candidate")
            .agg(F.sum("total").alias("total"))
            .collect()
        )
        totals = np.zeros(len(thetas))
        for row in rows:
            totals[row["candidate"]] = row["total"]
        return -totals / weight + PENALTY * np.array([np.sum(t**2) for t in thetas])

    return score


def bgnbd_fit(observations: DataFrame) -> PurchaseModel:
    """``observations``: written table of distinct (frequency, recency, T) with weights."""
    weight, oldest = observations.agg(F.sum("weight"), F.max("T")).first()
    if not weight:
        raise ValueError("no customers to fit the purchase model on")
    scale = SCALED_AGE / max(oldest, 1.0)

    def log_likelihood(x, tx, age, theta):
        return purchase_log_likelihood(x, tx * scale, age * scale, theta)

    score = _scorer(observations, ["frequency", "recency", "T"], log_likelihood, weight)
    point, value, used = minimise(score, np.zeros(4))
    r, alpha, a, b = np.exp(point)
    return PurchaseModel(float(r), float(alpha / scale), float(a), float(b), value, used)


def gamma_gamma_fit(observations: DataFrame) -> SpendModel:
    """``observations``: written table of distinct (frequency, monetary_value) with weights."""
    weight = observations.agg(F.sum("weight")).first()[0]
    if not weight:
        raise ValueError("no repeat customers to fit the spend model on")
    score = _scorer(observations, ["frequency", "monetary_value"], spend_log_likelihood, weight)
    point, value, used = minimise(score, np.zeros(3))
    p, q, v = np.exp(point)
    return SpendModel(float(p), float(q), float(v), value, used)


def expected_purchases(horizon: float, x, tx, age, model: PurchaseModel) -> np.ndarray:
    """Expected purchases in the next ``horizon`` days given the history of each customer.

    Euler's transformation takes the power of (1 - z) out of 2F1, so nothing overflows for
    frequent buyers and the series converges fast.
    """
    if horizon <= 0:
        return np.zeros_like(x)
    r, alpha, b = model.r, model.alpha, model.b
    a = model.a if abs(model.a - 1.0) > 1e-6 else 1.0 + 1e-6
    z = horizon / (alpha + age + horizon)
    series = hypergeometric(a + b - 1.0 - r, a - 1.0, a + b + x - 1.0, z)
    gained = (a + b + x - 1.0) / (a - 1.0) * (1.0 - (1.0 - z) ** (a - 1.0) * series)
    dropped = np.where(x > 0, a / (b + np.where(x > 0, x, 1.0) - 1.0), 0.0)
    with np.errstate(over="ignore"):
        odds = dropped * np.exp((r + x) * (np.log(alpha + age) - np.log(alpha + tx)))
    return gained / (1.0 + odds)


def repeat_customers(rft: DataFrame) -> DataFrame:
    return rft.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))


def predict(
    rft: DataFrame,
    purchases: PurchaseModel,
    spend: SpendModel | None = None,
    horizon: int = HORIZON_DAYS,
    months: int = MONTHS,
) -> DataFrame:
    """Expected purchases over the horizon and, with a spend model, discounted value."""

    @F.pandas_udf("predicted double, discounted double")
    def forecast(x: pd.Series, tx: pd.Series, age: pd.Series) -> pd.DataFrame:
        x, tx, age = (s.to_numpy(dtype=float) for s in (x, tx, age))
        known = np.zeros_like(x)
        discounted = np.zeros_like(x)
        for month in range(1, months + 1):
            reached = expected_purchases(month * DAYS_PER_STEP, x, tx, age, purchases)
            discounted += (reached - known) / (1.0 + DISCOUNT_RATE) ** month
            known = reached
        return pd.DataFrame(
            {"predicted": expected_purchases(horizon, x, tx, age, purchases), "discounted": discounted}
        )

    scored = repeat_customers(rft).withColumn("_f", forecast("frequency", "recency", "T"))
    columns = [F.col("_f.predicted").alias("predicted_6m_purchases")]
    if spend is not None:
        evidence = F.lit(spend.p) * F.col("frequency")
        own = evidence / (evidence + F.lit(spend.q) - 1)
        overall = F.lit(spend.v * spend.p / (spend.q - 1))
        average = (1 - own) * overall + own * F.col("monetary_value")
        columns.append((F.col("_f.discounted") * average).alias("predicted_6m_ltv"))
    return scored.select(CUSTOMER, "frequency", "recency", "T", "monetary_value", *columns)


def ltv_describe(predictions: DataFrame, **limits) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of the four value columns."""
    columns = ["frequency", "monetary_value", "predicted_6m_purchases", "predicted_6m_ltv"]
    basics = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = predictions.agg(
        *[f(c).cast("double").alias(f"{name}_{c}") for name, f in basics.items() for c in columns]
    ).first()
    quartiles = {c: exact_quantiles(predictions, c, [0.25, 0.5, 0.75], **limits) for c in columns}
    table = [(name, *[row[f"{name}_{c}"] for c in columns]) for name in ("count", "mean", "std", "min")]
    table += [(label, *[quartiles[c][i] for c in columns]) for i, label in enumerate(("25%", "50%", "75%"))]
    table.append(("max", *[row[f"max_{c}"] for c in columns]))
    schema = "statistic string, " + ", ".join(f"{c} double" for c in columns)
    return predictions.sparkSession.createDataFrame(table, schema)
