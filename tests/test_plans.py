"""Plan shape and independence of the physical layout."""

from dataclasses import replace
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from stallwise import warehouse
from stallwise.jobs import JOBS
from stallwise.operators import cuts, grouping, running
from stallwise.operators.grouping import Layout
from stallwise.plans import facts
from stallwise.sources import driver_tables, tables
from stallwise.warehouse import Warehouse
from stallwise.workspace import new_path
from tests.conftest import SMALL

LAZY = [
    "orders_enriched", "order_item_geo", "order_level", "customer_agg", "customer_level", "monthly_metrics",
    "monthly_customer_mix", "cohort_activity", "cohort_retention", "category_summary", "seller_summary",
    "state_summary", "route_summary", "distance_summary", "rft_summary", "exp_first_orders", "exp_financials",
    "pareto_curve", "segment_category_mix", "model_orders", "order_sequence", "dq_foreign_key",
]
LAYOUT_SENSITIVE = [
    "geo_zip", "payments_agg", "order_level", "customer_level", "order_sequence", "monthly_customer_mix",
    "cohort_retention", "seller_summary", "distance_summary", "ltv_quantiles", "rft_summary", "pareto_curve",
    "segment_category_mix", "exp_uplift_score", "model_orders", "model_sample_split",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_and_no_copied_rows(small, name):
    text = plan(JOBS[name].run(small))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Expand", "BatchEvalPython"):
        assert operator not in text


@pytest.mark.parametrize("name", ["order_level", "customer_agg", "cohort_activity", "order_sequence", "model_orders",
                                  "category_summary", "exp_first_orders", "segment_category_mix", "rft_summary"])
def test_fact_sized_results_are_not_gathered(small, name):
    text = plan(JOBS[name].run(small))
    gathered = text.count("Exchange SinglePartition")
    # the running numbers gather one row per range; a scalar subquery gathers one row per task
    assert gathered <= (1 if name in {"order_sequence", "rft_summary"} else 0)


@pytest.mark.parametrize("name", ["fact_preview", "fact_preview_orders", "top_categories", "top_sellers", "risky_sellers"])
def test_previews_are_top_k(small, name):
    assert "TakeOrderedAndProject" in plan(JOBS[name].run(small))


def test_marts_prune_and_push_down(small):
    text = plan(JOBS["monthly_metrics"].run(small))
    assert "PushedFilters: [In(order_status" in text
    scan = text[text.index("ReadSchema") :]
    assert "order_gmv" in scan and "payment_value" not in scan and "freight_gmv" not in scan


@pytest.mark.parametrize("name, exchanges", [("order_level", 1), ("model_orders", 1), ("payments_agg", 1)])
def test_rows_of_an_order_are_shuffled_once(small, name, exchanges):
    """The item fact lies by order: order attributes are brought to it; combined items and payments move once."""
    text = plan(JOBS[name].run(small))
    assert text.count("Exchange hashpartitioning(order_id") <= exchanges
    assert text.count("Exchange hashpartitioning") == text.count("Exchange hashpartitioning(order_id")
    if name != "payments_agg":
        assert "Bucketed: true" in text


@pytest.mark.parametrize("name", ["rft_summary", "cohort_retention", "segment_category_mix"])
def test_rows_of_a_customer_are_shuffled_once(small, name):
    text = plan(JOBS[name].run(small))
    # one exchange of the fact's rows, written as a repartition; the other side of a join has its own
    assert text.count("Exchange hashpartitioning(customer_unique_id#") - text.count("ENSURE_REQUIREMENTS") <= 1
    assert "REPARTITION_BY_COL" in text


def test_windows_read_their_months_only(small):
    text = plan(JOBS["exp_outcomes"].run(small))
    filters = text[text.index("PartitionFilters") :].split("]")[0]
    assert filters.count("purchase_month") >= 2 and ">=" in filters and "<=" in filters


def test_one_month_is_replaced(spark, small):
    path = new_path(spark, "months")
    orders = small.order_fact.select("order_id", "order_gmv", "purchase_month")
    tables.write_table(orders, path, by=["purchase_month"])
    month = orders.where("purchase_month = date'1999-03-01'")
    tables.write_table(month.withColumn("order_gmv", F.col("order_gmv") * 0), path, mode="overwrite", by=["purchase_month"])
    stored = spark.read.parquet(path)
    assert stored.count() == orders.count() and month.count() > 0
    changed = stored.where("order_gmv = 0")
    assert changed.count() == month.count() and changed.where("purchase_month != date'1999-03-01'").count() == 0


def test_heavy_keys_are_seen(spark, monkeypatch):
    monkeypatch.setattr(grouping, "LIGHT_ROWS", 100)
    even = spark.range(60_000).select((F.col("id") % 1000).alias("k"))
    assert grouping.layout_of(even, "k") is Layout.LIGHT
    third = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert grouping.layout_of(third, "k") is Layout.ANY
    monkeypatch.setattr(grouping, "SAMPLE_ROWS", 5_000)
    assert grouping.layout_of(third, "k") is Layout.ANY
    assert grouping.layout_of(spark.range(0).toDF("k"), "k") is Layout.LIGHT


def _results(spark, name, warehouse):
    df = JOBS[name].run(warehouse)
    return sorted(df.collect(), key=str)


@pytest.fixture(scope="module")
def base(spark, small):
    return {name: _results(spark, name, small) for name in LAYOUT_SENSITIVE}


@pytest.mark.parametrize("partitions", [1, 23])
def test_results_do_not_depend_on_partitions(spark, base, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        fresh = Warehouse(driver_tables.load(spark, SMALL), datetime(1999, 1, 1))
        for name in LAYOUT_SENSITIVE:
            assert _results(spark, name, fresh) == base[name], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_results_do_not_depend_on_size_limits(spark, base, monkeypatch):
    """The paths for many ranges and sampled cuts give the same rows."""
    monkeypatch.setattr(running, "MIN_ROWS_PER_RANGE", 20)
    monkeypatch.setattr(cuts.cut_points, "__defaults__", (None, 50, 40, frozenset()))
    fresh = Warehouse(driver_tables.load(spark, SMALL), datetime(1999, 1, 1))
    for name in LAYOUT_SENSITIVE:
        assert _results(spark, name, fresh) == base[name], name


def test_results_do_not_depend_on_heavy_keys(spark, base, monkeypatch):
    """With heavy keys everywhere the facts lie as they come, rows are combined first, and nothing changes."""
    monkeypatch.setattr(warehouse, "layout_of", lambda df, key: Layout.ANY)
    fresh = Warehouse(driver_tables.load(spark, SMALL), datetime(1999, 1, 1))
    assert fresh.item_buckets is None
    for name in LAYOUT_SENSITIVE:
        assert _results(spark, name, fresh) == base[name], name


def test_order_fact_alone_writes_no_item_fact(spark):
    """Queries on orders shuffle the few item columns that they need; the rows are those of the written fact."""
    alone, both = (Warehouse(driver_tables.load(spark, SMALL)) for _ in range(2))
    assert both.item_fact.count() > 0
    shown = JOBS["order_level"].columns.split()
    fields = [c.split(":")[0] for c in shown if c != "avg_distance_km:d"]
    rows = [
        {r.order_id: (r.avg_distance_km, tuple(r[f] for f in fields)) for r in w.order_fact.collect()} for w in (alone, both)
    ]
    assert "item_fact" not in alone._kept and rows[0].keys() == rows[1].keys()
    for key, (distance, others) in rows[0].items():
        assert others == rows[1][key][1] and distance == pytest.approx(rows[1][key][0], nan_ok=True)


def test_items_and_orders_join_where_they_lie(spark):
    """Both facts lie by order, so their join moves no row; sellers come to the items."""
    wh = Warehouse(driver_tables.load(spark, SMALL))
    totals = lambda: facts.order_totals(wh.item_fact, wh.orders_enriched, wh.item_layout)
    assert wh.item_buckets == wh.order_buckets and totals().count() > 0
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = totals()._jdf.queryExecution().executedPlan().toString()
        items = wh.item_plan(wh.orders_enriched, wh.geo_zip, wh.item_buckets)
        item_plan = items._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "hashpartitioning(seller_id" not in item_plan and "hashpartitioning(product_id" in item_plan


def test_many_sellers_and_repeated_orders_give_the_same_items(spark, monkeypatch):
    def rows(change) -> list:
        raw = driver_tables.load(spark, SMALL)
        twice = raw.orders.where("order_id % 5 = 0")
        raw = replace(raw, orders=raw.orders.unionByName(twice))
        wh = Warehouse(raw)
        change(wh)
        return sorted(map(str, wh.item_fact.drop("seller_lat", "customer_lat", "distance_km").collect()))

    few = rows(lambda wh: None)
    monkeypatch.setattr(facts, "FEW_SELLERS", 0)
    assert rows(lambda wh: wh._kept.update(layout_raw_orders_order_id=Layout.ANY)) == few
