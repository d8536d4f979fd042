"""Order-value model: features per order, sampling, random forest, metrics, importances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit, ratio
from ..operators.cuts import SortKey, cut_points, exact_quantiles
from ..operators.grouping import combined_on, mark_values, smallest_mode
from ..workspace import materialise

CATEGORY = "product_category_name_english"
# Group sizes, sample size, split, forest settings, payment label, features.
TOP_CATEGORIES, TOP_STATES = 20, 10
SAMPLE_SIZE, TEST_SHARE, PLOT_ROWS = 40_000, 0.25, 3_000
TREES, DEPTH, MIN_LEAF, SEED = 80, 14, 5, 42
PAYMENT_LABELS = {"boleto": "bank_slip"}
NUMERIC = [
    "item_count",
    "category_count",
    "avg_weight_g",
    "avg_volume_cm3",
    "seller_count",
    "same_state_share",
    "payment_installments",
]
CATEGORICAL = ["main_category", "main_seller_state", "customer_state", "payment_type"]
MAX_BINS = 32
# the training sample is bounded, so is its parallelism
TRAIN_PARTS = 8


def model_items(completed_items: DataFrame) -> DataFrame:
    return completed_items.where(F.col("order_id").isNotNull() & (F.col("item_gmv") > 0)).select(
        "order_id",
        "order_item_id",
        "customer_state",
        "seller_state",
        CATEGORY,
        "item_gmv",
        "product_weight_g",
        "volume_cm3",
        "seller_id",
        "same_state_route",
        "payment_installments",
        "payment_type",
    )


def top_values(items: DataFrame) -> DataFrame:
    """The most frequent categories and states (rows: feature, value, row_count, value_rank).

    One pass counts the combinations, a small dimension-sized table; the rankings use that.
    """
    combos = items.groupBy(CATEGORY, "customer_state", "seller_state").agg(F.count("*").alias("_n"))
    frames = []
    for column, n in ((CATEGORY, TOP_CATEGORIES), ("customer_state", TOP_STATES), ("seller_state", TOP_STATES)):
        frames.append(
            combos.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value"))
            .agg(F.sum("_n").alias("row_count"))
            .orderBy(F.col("row_count").desc(), "value")
            .limit(n)
            .select(F.lit(column).alias("feature"), "value", "row_count")
        )
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def with_groups(items: DataFrame, top: DataFrame) -> DataFrame:
    """Rare and missing values become 'other'; the lookups have at most 20 and 10 rows."""
    result = items
    for column, name in (
        (CATEGORY, "category_group"),
        ("customer_state", "customer_state_group"),
        ("seller_state", "seller_state_group"),
    ):
        known = top.where(F.col("feature") == column).select(F.col("value").alias("_value"))
        result = (
            result.join(F.broadcast(known), F.col(column) == F.col("_value"), "left")
            .withColumn(name, F.coalesce("_value", F.lit("other")))
            .drop("_value")
        )
    return result.replace(PAYMENT_LABELS, subset=["payment_type"])


def model_orders(grouped_items: DataFrame) -> DataFrame:
    """One row of features per order, from one order_id partitioning of pre-combined items.

    On the bucketed item fact the items are combined where they lie; the narrower combined rows then move once,
    which measured faster than sorting them three times in the scanning tasks.

    Customer state, payment type and instalments belong to the order, so they are group keys.
    """
    order_keys = ["order_id", "customer_state_group", "payment_type", "payment_installments"]
    sums = ["_gmv", "_items", "_rows", "_weight", "_weighed", "_volume", "_volumes", "_same"]

    def per_seller_and_category(items: DataFrame) -> DataFrame:
        return items.groupBy(*order_keys, "seller_id", "seller_state_group", "category_group").agg(
            F.sum("item_gmv").alias("_gmv"),
            F.count("order_item_id").alias("_items"),
            F.count("*").alias("_rows"),
            F.sum("product_weight_g").alias("_weight"),
            F.count("product_weight_g").alias("_weighed"),
            F.sum("volume_cm3").alias("_volume"),
            F.count("volume_cm3").alias("_volumes"),
            F.sum("same_state_route").alias("_same"),
        )

    marked = combined_on(grouped_items, "order_id", per_seller_and_category)
    for column, tie, prefix in (
        ("seller_id", "category_group", "_seller"),
        ("category_group", "seller_id", "_category"),
        ("seller_state_group", "seller_id", "_state"),
    ):
        marked = mark_values(marked, "order_id", column, "_rows", tie, prefix)
    joined = marked.groupBy(*order_keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.sum("_seller_first").alias("seller_count"),
        F.sum("_category_first").alias("category_count"),
        smallest_mode("category_group", "_category_weight").alias("main_category"),
        smallest_mode("seller_state_group", "_state_weight").alias("main_seller_state"),
    )
    return joined.select(
        "order_id",
        F.col("_gmv").cast("double").alias("gmv"),
        F.col("_items").alias("item_count"),
        "category_count",
        "main_category",
        ratio(F.col("_weight"), F.col("_weighed")).alias("avg_weight_g"),
        ratio(F.col("_volume"), F.col("_volumes")).alias("avg_volume_cm3"),
        "seller_count",
        "main_seller_state",
        F.col("customer_state_group").alias("customer_state"),
        ratio(F.col("_same"), F.col("_rows")).alias("same_state_share"),
        "payment_installments",
        "payment_type",
    )


def sampled_items(items: DataFrame, orders: DataFrame, size: int = SAMPLE_SIZE, **limits) -> DataFrame:
    """Items of exactly ``min(size, n)`` orders that have items, those with the smallest salted hash.

    ``orders`` holds every order once and is drawn first: only hashes that should leave about
    twice the sample are looked up among the items. The exact cut-off is found in that small
    table, so features are computed for the sampled orders alone.
    """
    drawn = orders.select("order_id", hash_unit("sample-42", "order_id").alias("_draw"))
    share = min(1.0, 2.0 * size / max(orders.count(), 1))
    while True:
        near = materialise(drawn.where(F.col("_draw") < share), "sample-near")
        used = materialise(items.select("order_id").join(near, "order_id").distinct(), "sample-used")
        found = used.count()
        if found >= size or share >= 1.0:
            break
        share = min(1.0, share * 2)
    if found > size:
        key = ["_draw", "order_id"]
        cut = cut_points(used, key, [size], rows=found, **limits)[size]
        used = used.where(SortKey(key).up_to(cut.key))
    # at most ``size`` ids are left
    return items.join(F.broadcast(used.select("order_id")), "order_id", "left_semi")


def is_held_out(test_share: float = TEST_SHARE) -> Column:
    """Whether an order is kept from the fit: a salted hash of its id, whatever is sampled."""
    return hash_unit("split-42", "order_id") < test_share


def held_out_items(items: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Items of all held-out orders, chosen before any features are computed."""
    return items.where(is_held_out(test_share))


def model_sample_split(sampled_orders: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Stable train/test flag by a second salted hash, and the log target."""
    return sampled_orders.withColumns({"is_test": is_held_out(test_share), "label": F.log1p("gmv")})


@dataclass(frozen=True)
class FittedModel:
    pipeline: PipelineModel
    fills: dict[str, str]

    def prepare(self, orders: DataFrame) -> DataFrame:
        numbers = [F.col(c).cast("double").alias(c) for c in NUMERIC]
        others = [c for c in orders.columns if c not in NUMERIC]
        return orders.select(*others, *numbers).fillna(self.fills)


def model_fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH) -> FittedModel:
    """Impute, one-hot encode (unseen values encode to zeros) and fit the forest on the train part."""
    train = sample.where(~F.col("is_test"))
    # the sample has at most SAMPLE_SIZE rows, so mode() holds a small map
    modes = train.agg(*[F.mode(c, True).alias(c) for c in CATEGORICAL]).first().asDict()
    fitted = FittedModel(None, {c: v if v is not None else "other" for c, v in modes.items()})
    indexed, encoded = [f"{c}_index" for c in CATEGORICAL], [f"{c}_onehot" for c in CATEGORICAL]
    imputed = [f"{c}_imputed" for c in NUMERIC]
    stages = [
        Imputer(strategy="median", inputCols=NUMERIC, outputCols=imputed),
        StringIndexer(inputCols=CATEGORICAL, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=imputed + encoded, outputCol="features"),
        RandomForestRegressor(
            numTrees=trees,
            maxDepth=depth,
            minInstancesPerNode=MIN_LEAF,
            featureSubsetStrategy="all",
            maxBins=MAX_BINS,
            maxMemoryInMB=1024,
            cacheNodeIds=True,
            seed=SEED,
        ),
    ]
    # a fixed layout by key keeps the bootstrap samples, and so the forest, reproducible
    ready = materialise(fitted.prepare(train), "model-train")
    ready = ready.repartition(TRAIN_PARTS, "order_id").sortWithinPartitions("order_id")
    return FittedModel(Pipeline(stages=stages).fit(ready), fitted.fills)


def describe_fit(model: FittedModel, sample: DataFrame) -> DataFrame:
    forest = model.pipeline.stages[-1]
    counts = sample.agg(
        F.count("*").alias("sampled_orders"),
        F.count(F.when(~F.col("is_test"), 1)).alias("train_orders"),
        F.count(F.when(F.col("is_test"), 1)).alias("test_orders"),
    )
    return counts.withColumns(
        {
            "trees": F.lit(forest.getNumTrees),
            "total_nodes": F.lit(forest.totalNumNodes),
            "features": F.lit(forest.numFeatures),
        }
    )


def model_score(model: FittedModel, orders: DataFrame) -> DataFrame:
    """One prediction on the GMV scale per row of order features: a narrow transform, the forest is all it carries.

    An order outside the sample is imputed and encoded as the fit decided, like one inside it.
    """
    scored = model.pipeline.transform(model.prepare(orders))
    return scored.select("order_id", F.col("gmv").alias("actual"), F.expm1("prediction").alias("predicted"))


def model_metrics(scored: DataFrame, sample_size: int) -> DataFrame:
    """Errors over all held-out orders: one pass of mergeable sums, then the exact median.

    ``scored`` should be a written table; ``sample_size`` is the number of orders that the fit drew from.
    """
    error = F.col("actual") - F.col("predicted")
    row = scored.agg(
        F.count("*").alias("orders"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - ratio(F.sum(error * error), F.var_pop("actual") * F.count("actual"))).alias("r2"),
    ).first()
    (median,) = exact_quantiles(scored.select(F.abs(error).alias("e")), "e", [0.5])
    rows = [
        ("MAE", row["mae"]),
        ("Median absolute error", median),
        ("R-squared", row["r2"]),
        ("Sampled orders", float(sample_size)),
        ("Held-out orders", float(row["orders"])),
    ]
    return scored.sparkSession.createDataFrame(rows, "metric string, value double")


def feature_importance(model: FittedModel, sample: DataFrame, top: int | None = None) -> DataFrame:
    """Forest importances summed back from encoded columns to the source features."""
    vector = model.pipeline.transform(model.prepare(sample.limit(1))).schema["features"]
    names = {}
    for group in vector.metadata["ml_attr"]["attrs"].values():
        for attribute in group:
            names[attribute["idx"]] = attribute["name"]
    importances = model.pipeline.stages[-1].featureImportances.toArray()
    rows = [(names[i], float(v)) for i, v in enumerate(importances)]
    source = F.regexp_replace("feature", "(_imputed$|_onehot_.*$)", "")
    result = (
        sample.sparkSession.createDataFrame(rows, "feature string, importance double")
        .groupBy(source.alias("feature_group"))
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.col("importance").desc(), "feature_group")
    )
    return result.limit(top) if top else result


def pred_vs_actual_sample(scored: DataFrame, rows: int = PLOT_ROWS) -> DataFrame:
    """Up to ``rows`` (actual, predicted) pairs and the pooled 99th percentile as axis limit."""
    picked = scored.orderBy(hash_unit("plot-42", "order_id"), "order_id").limit(rows)
    pooled = picked.select(F.explode(F.array("actual", "predicted")).alias("v"))
    return picked.withColumn("axis_limit", pooled.agg(F.percentile("v", F.lit(0.99))).scalar())
