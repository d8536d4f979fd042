"""The tables of one dataset: lazily built, written once, shared by all jobs of a session."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .functions.scalars import month_of
from .operators.grouping import Layout, layout_of
from .plans import customers, enrich, experiment, facts, gmv_model, growth, lifetime, marts, strategy
from .sources import driver_tables
from .sources.schemas import RawTables
from .workspace import bucket_count, materialise, materialise_by, materialise_on

_open: dict[tuple, Warehouse] = {}


class Warehouse:
    """Silver and gold tables over nine raw tables.

    The wide joins (orders with attributes, item fact, order fact) and every table that is read
    several times are written to the shared folder; everything else stays a lazy plan on them.
    """

    def __init__(
        self, raw: RawTables, cutoff: datetime = experiment.CUTOFF, fit_orders: int = gmv_model.SAMPLE_SIZE
    ):
        """``fit_orders`` bounds the orders that the order-value model is fitted on; all held-out ones are scored."""
        self.raw = raw
        self.cutoff = cutoff
        self.fit_orders = fit_orders
        self._kept: dict[str, object] = {}

    def _keep(self, name: str, build: Callable[[], object]):
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def _written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self._keep(name, lambda: materialise(build(), name))

    def _layout(self, name: str, df: DataFrame, key: str) -> Layout:
        return self._keep(f"layout_{name}_{key}", lambda: layout_of(df, key))

    # plans straight from the raw tables

    def products_plan(self) -> DataFrame:
        return enrich.products_enriched(self.raw.products, self.raw.product_category_translation)

    def geo_zip_plan(self) -> DataFrame:
        return enrich.geo_zip(self.raw.geolocation)

    def customers_plan(self, geo: DataFrame | None = None) -> DataFrame:
        return enrich.customers_enriched(self.raw.customers, self.geo_zip_plan() if geo is None else geo)

    def sellers_plan(self, geo: DataFrame | None = None) -> DataFrame:
        return enrich.sellers_enriched(self.raw.sellers, self.geo_zip_plan() if geo is None else geo)

    def payments_plan(self, buckets: int | None = None) -> DataFrame:
        payments = self.raw.order_payments
        return enrich.payments_agg(payments, self._layout("payments", payments, "order_id"), buckets)

    def orders_plan(self, geo: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
        return enrich.orders_enriched(
            self.raw.orders,
            self.customers_plan(geo),
            self.payments_plan(buckets),
            enrich.reviews_agg(self.raw.order_reviews),
            buckets,
        )

    def item_plan(
        self, orders: DataFrame | None = None, geo: DataFrame | None = None, buckets: int | None = None
    ) -> DataFrame:
        base = facts.order_item_base(
            self.raw.order_items,
            self.products_plan(),
            self.sellers_plan(geo),
            self.orders_plan() if orders is None else orders,
            buckets,
            self._keep("few_sellers", lambda: self.raw.sellers.count() <= facts.FEW_SELLERS),
        )
        return facts.order_item_geo(base)

    # written tables

    @property
    def geo_zip(self) -> DataFrame:
        return self._written("geo_zip", self.geo_zip_plan)

    @property
    def order_buckets(self) -> int | None:
        """As many as of the items, so that both join where they lie; None if an order's rows are many."""
        if self._layout("raw_orders", self.raw.orders, "order_id") is Layout.ANY:
            return None
        return self.item_buckets

    @property
    def orders_enriched(self) -> DataFrame:
        def build() -> DataFrame:
            plan = self.orders_plan(self.geo_zip, self.order_buckets)
            if self.order_buckets:
                return materialise_on(plan, "orders_enriched", "order_id", self.order_buckets)
            return materialise(plan, "orders_enriched")

        return self._keep("orders_enriched", build)

    @property
    def item_buckets(self) -> int | None:
        """Buckets of the item fact by order; None if one order holds much of the items, which are then left as
        they come."""

        def choose() -> int | None:
            items = self.raw.order_items
            if self._layout("items", items, "order_id") is Layout.ANY:
                return None
            return bucket_count(items.sparkSession, items.count())

        return self._keep("item_buckets", choose)

    @property
    def item_layout(self) -> Layout:
        """How the item fact lies by order."""
        return Layout.PLACED if self.item_buckets else Layout.ANY

    @property
    def item_fact(self) -> DataFrame:
        def build() -> DataFrame:
            plan = self.item_plan(self.orders_enriched, self.geo_zip, self.item_buckets)
            if self.item_buckets:
                return materialise_on(plan, "item_fact", "order_id", self.item_buckets)
            return materialise(plan, "item_fact")

        return self._keep("item_fact", build)

    def order_plan(self) -> DataFrame:
        return facts.order_level(self.item_fact, self.orders_enriched, self.item_layout)

    @property
    def order_fact(self) -> DataFrame:
        """From the written item fact if there is one; else from its plan, of which only the few columns that orders
        need are shuffled and nothing is written."""

        def build() -> DataFrame:
            items = self._kept.get("item_fact")
            if items is None:
                items = self.item_plan(self.orders_enriched, self.geo_zip, self.item_buckets)
            totals = facts.order_totals(items, self.orders_enriched, self.item_layout)
            placed = totals.withColumn("purchase_month", month_of("order_purchase_timestamp"))
            return materialise_by(placed, "order_fact", "purchase_month", facts.order_features)

        return self._keep("order_fact", build)

    @property
    def customer_layout(self) -> Layout:
        """How the orders weigh by customer."""
        return self._layout("orders", self.order_fact, "customer_unique_id")

    @property
    def customer_agg(self) -> DataFrame:
        return self._written("customer_agg", lambda: customers.customer_agg(self.completed_orders))

    @property
    def category_summary(self) -> DataFrame:
        return self._written("category_summary", lambda: marts.category_summary(self.completed_items))

    @property
    def seller_base(self) -> DataFrame:
        return self._written("seller_base", lambda: marts.seller_base(self.completed_items))

    @property
    def rft(self) -> DataFrame:
        return self._written("rft", self.rft_plan)

    def rft_plan(self) -> DataFrame:
        return lifetime.rft_summary(lifetime.ltv_transactions(self.delivered_orders), self.customer_layout)

    @property
    def population(self) -> DataFrame:
        def build() -> DataFrame:
            firsts = experiment.first_orders(self.completed_orders)
            return experiment.population(
                experiment.eligible(firsts, self.cutoff), experiment.outcomes(self.completed_orders, self.cutoff)
            )

        return self._written("population", build)

    @property
    def experiment(self) -> DataFrame:
        def build() -> DataFrame:
            scored = experiment.uplift_score(experiment.assign(self.population))
            return experiment.financials(experiment.induced(scored))

        return self._keep("experiment", build)

    @property
    def model_items(self) -> DataFrame:
        return gmv_model.model_items(self.completed_items)

    @property
    def top_values(self) -> DataFrame:
        return self._written("top_values", lambda: gmv_model.top_values(self.model_items))

    @property
    def grouped_items(self) -> DataFrame:
        return gmv_model.with_groups(self.model_items, self.top_values)

    @property
    def model_sample(self) -> DataFrame:
        def build() -> DataFrame:
            items = gmv_model.sampled_items(self.model_items, self.completed_orders, self.fit_orders)
            orders = gmv_model.model_orders(gmv_model.with_groups(items, self.top_values))
            return gmv_model.model_sample_split(orders)

        return self._written("model_sample", build)

    @property
    def model(self) -> gmv_model.FittedModel:
        return self._keep("model", lambda: gmv_model.model_fit(self.model_sample))

    @property
    def held_out_orders(self) -> DataFrame:
        """Features of every held-out order, sampled or not."""
        items = gmv_model.held_out_items(self.model_items)
        return gmv_model.model_orders(gmv_model.with_groups(items, self.top_values))

    def model_orders_plan(self) -> DataFrame:
        return gmv_model.model_orders(self.grouped_items)

    @property
    def model_scored(self) -> DataFrame:
        return self._written("model_scored", lambda: gmv_model.model_score(self.model, self.held_out_orders))

    # lazy tables on the written ones

    @property
    def completed_orders(self) -> DataFrame:
        return facts.completed(self.order_fact)

    @property
    def delivered_orders(self) -> DataFrame:
        return facts.delivered(self.order_fact)

    @property
    def completed_items(self) -> DataFrame:
        return facts.completed(self.item_fact)

    @property
    def customer_level(self) -> DataFrame:
        return self._keep(
            "customer_level", lambda: customers.customer_level(customers.customer_rfm(self.customer_agg))
        )

    @property
    def seller_summary(self) -> DataFrame:
        return self._keep("seller_summary", lambda: marts.seller_summary(self.seller_base))

    @property
    def distance_summary(self) -> DataFrame:
        return self._keep("distance_summary", lambda: marts.distance_summary(self.completed_items))

    @property
    def monthly(self) -> DataFrame:
        return growth.monthly_metrics(self.completed_orders)

    @property
    def customer_mix(self) -> DataFrame:
        return growth.monthly_customer_mix(self.completed_orders)

    @property
    def retention(self) -> DataFrame:
        return growth.cohort_retention(self.completed_orders, self.customer_layout)

    @property
    def segment_mix(self) -> DataFrame:
        layout = self._layout("items", self.item_fact, "customer_unique_id")
        return strategy.segment_category_mix(self.completed_items, self.customer_level, layout=layout)

    def curve(self, entity: str) -> DataFrame:
        source = {
            "customers": (customers.customer_rfm(self.customer_agg), "customer_unique_id", "realized_ltv"),
            "sellers": (self.seller_base, "seller_id", "gmv"),
            "categories": (self.category_summary, marts.CATEGORY, "gmv"),
        }[entity]
        return self._keep(f"curve_{entity}", lambda: strategy.pareto_curve(*source))

    @property
    def purchase_model(self) -> lifetime.PurchaseModel:
        def build():
            return lifetime.bgnbd_fit(materialise(lifetime.purchase_observations(self.rft), "purchase_observations"))

        return self._keep("purchase_model", build)

    @property
    def spend_model(self) -> lifetime.SpendModel:
        def build():
            return lifetime.gamma_gamma_fit(materialise(lifetime.spend_observations(self.rft), "spend_observations"))

        return self._keep("spend_model", build)

    @property
    def predictions(self) -> DataFrame:
        return self._written(
            "predictions", lambda: lifetime.predict(self.rft, self.purchase_model, self.spend_model)
        )


def _fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """Size, file count and modification time of the source files, from the file system's metadata."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    marks = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        size = fs.getContentSummary(target)
        marks.append((path, size.getLength(), size.getFileCount(), fs.getFileStatus(target).getModificationTime()))
    return tuple(marks)


def open_driver_tables(spark: SparkSession, folder: str, cutoff: datetime) -> Warehouse:
    """Warehouse over the test tables in ``folder``; reused within a session while they are unchanged."""
    folder = folder.rstrip("/")
    paths = [f"{folder}/{t}.parquet" for t in driver_tables.SOURCE_TABLES]
    key = (spark.sparkContext.applicationId, cutoff, _fingerprint(spark, paths))
    if key not in _open:
        _open[key] = Warehouse(driver_tables.load(spark, folder), cutoff)
    return _open[key]
