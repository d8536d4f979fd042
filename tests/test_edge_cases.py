"""Hand-made rows for the semantics that the generated tables do not exercise."""

import math
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallwise.functions.scalars import great_circle_km
from stallwise.plans import customers, enrich, experiment, facts, gmv_model, growth, lifetime, logistics, marts
from stallwise.plans import quality, strategy
from tests.frames import raw, table, warehouse


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


ORDERS = [
    dict(order_id="o1", customer_id="c1", order_status="delivered", order_purchase_timestamp="2017-01-05 10:00:00",
         order_approved_at="2017-01-05 22:00:00", order_delivered_customer_date="2017-01-10 10:00:00",
         order_estimated_delivery_date="2017-01-10 10:00:00"),
    dict(order_id="o2", customer_id="c2", order_status="delivered", order_purchase_timestamp="2017-01-20 00:00:00",
         order_delivered_customer_date="2017-02-10 00:00:00", order_estimated_delivery_date="2017-02-01 00:00:00"),
    dict(order_id="o3", customer_id="c3", order_status="shipped", order_purchase_timestamp="2017-03-01 00:00:00"),
    dict(order_id="o4", customer_id="c4", order_status="canceled", order_purchase_timestamp="2017-06-01 00:00:00"),
    dict(order_id="o5", customer_id="c1", order_status="delivered", order_purchase_timestamp="2017-07-01 00:00:00"),
]
CUSTOMERS = [
    dict(customer_id="c1", customer_unique_id="u1", customer_zip_code_prefix=1, customer_state="SP"),
    dict(customer_id="c2", customer_unique_id="u1", customer_zip_code_prefix=1, customer_state="SP"),
    dict(customer_id="c3", customer_unique_id="u2", customer_zip_code_prefix=2, customer_state="RJ"),
    dict(customer_id="c4", customer_unique_id="u3", customer_state=None),
]
ITEMS = [
    dict(order_id="o1", order_item_id=1, product_id="p1", seller_id="s1", price=10, freight_value=2),
    dict(order_id="o1", order_item_id=2, product_id="p2", seller_id="s2", price=5, freight_value=0),
    dict(order_id="o2", order_item_id=1, product_id="p1", seller_id="s1", price=0, freight_value=0),
    dict(order_id="o3", order_item_id=1, product_id="p3", seller_id="gone", price=8, freight_value=1),
    dict(order_id="o4", order_item_id=1, product_id="gone", seller_id="s1", price=3, freight_value=1),
]
PRODUCTS = [
    dict(product_id="p1", product_category_name="beleza", product_length_cm=2000, product_height_cm=2000,
         product_width_cm=2000),
    dict(product_id="p2", product_category_name=None, product_length_cm=2, product_height_cm=None, product_width_cm=2),
    dict(product_id="p3", product_category_name="sem_traducao"),
]
SELLERS = [
    dict(seller_id="s1", seller_zip_code_prefix=1, seller_state="SP"),
    dict(seller_id="s2", seller_zip_code_prefix=9, seller_state="RJ"),
]
GEO = [
    dict(geolocation_zip_code_prefix=1, geolocation_lat=-23, geolocation_lng=-46, geolocation_city=c, geolocation_state="SP")
    for c in ("zeta", "alfa", "zeta", "alfa", None)
] + [dict(geolocation_zip_code_prefix=2, geolocation_lat=-22, geolocation_lng=-43)]
PAYMENTS = [
    dict(order_id="o1", payment_sequential=1, payment_type="voucher", payment_installments=1, payment_value=10),
    dict(order_id="o1", payment_sequential=2, payment_type="credit_card", payment_installments=3, payment_value=7),
    dict(order_id="o2", payment_sequential=1, payment_type=None, payment_installments=1, payment_value=1),
]
REVIEWS = [
    dict(review_id="r1", order_id="o1", review_score=4, review_comment_message=""),
    dict(review_id="r1", order_id="o1", review_score=5, review_comment_message=None),
    dict(review_id="r2", order_id="o2", review_score=1),
]
TRANSLATION = [dict(product_category_name="beleza", product_category_name_english="beauty")]


@pytest.fixture(scope="module")
def shop(spark):
    return warehouse(
        spark, orders=ORDERS, customers=CUSTOMERS, order_items=ITEMS, products=PRODUCTS, sellers=SELLERS,
        geolocation=GEO, order_payments=PAYMENTS, order_reviews=REVIEWS, product_category_translation=TRANSLATION,
    )


def test_unknown_categories(shop):
    names = by(shop.products_plan(), "product_id", "product_category_name", "product_category_name_english")
    assert names == {"p1": ("beleza", "beauty"), "p2": ("unknown", "unknown"), "p3": ("sem_traducao", "unknown")}


def test_geo_zip_modes(shop):
    zips = by(shop.geo_zip_plan(), "geolocation_zip_code_prefix", "geolocation_city", "geolocation_state")
    assert zips == {1: ("alfa", "SP"), 2: (None, None)}


def test_payments_and_reviews(shop):
    paid = by(enrich.payments_agg(shop.raw.order_payments), "order_id", "payment_value", "payment_installments",
              "payment_type", "payment_type_nunique")
    assert paid["o1"] == (17, 3, "credit_card", 2)
    assert paid["o2"] == (1, 1, None, 0)
    reviewed = by(enrich.reviews_agg(shop.raw.order_reviews), "order_id", "review_score", "review_comment_rate", "review_count")
    assert reviewed["o1"] == (4.5, 0.5, 1)


def test_item_fact(shop):
    items = {(r.order_id, r.order_item_id): r for r in shop.item_fact.collect()}
    assert len(items) == 5
    assert items["o1", 1].volume_cm3 == 8_000_000_000
    assert items["o1", 2].volume_cm3 == 0
    assert items["o2", 1].freight_share is None
    assert [items[k].same_state_route for k in sorted(items)] == [1, 0, 1, 0, 0]
    assert items["o1", 1].distance_km == 0.0
    assert items["o1", 2].distance_km is None  # the seller's zip has no coordinates
    assert items["o4", 1].product_category_name_english is None


def test_antipodal_points(spark):
    points = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0)], "a double, b double, c double, d double")
    km = [r[0] for r in points.select(great_circle_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert km == pytest.approx([math.pi * 6371] * 2)


def test_order_level(shop):
    orders = {r.order_id: r for r in shop.order_fact.collect()}
    assert sorted(orders) == ["o1", "o2", "o3", "o4"]  # o5 has no items
    one = orders["o1"]
    assert (one.order_gmv, one.item_count, one.seller_count, one.category_count) == (17, 2, 2, 2)
    assert one.dominant_category == "beauty"
    assert (one.delivery_days, one.approval_lag_hours, one.is_late_delivery) == (5.0, 12.0, 0)
    assert one.gmv_payment_gap == 0
    assert orders["o2"].is_late_delivery == 1
    assert (orders["o3"].is_late_delivery, orders["o3"].delivery_days) == (0, None)
    assert (orders["o4"].category_count, orders["o4"].dominant_category) == (0, None)
    assert "o5" in by(enrich.order_time_features(shop.orders_enriched), "order_id")


def test_customers(shop):
    people = {r.customer_unique_id: r for r in shop.customer_level.collect()}
    assert sorted(people) == ["u1", "u2"]
    one = people["u1"]
    assert (one.total_orders, one.repeat_customer, one.late_delivery_rate) == (2, 1, 0.5)
    assert one.tenure_days == pytest.approx(14 + 14 / 24)
    assert one.purchase_frequency_per_month == pytest.approx(2 / (one.tenure_days / 30.4))
    assert people["u2"].purchase_frequency_per_month is None
    assert people["u2"].recency_days == 0.0  # anchored on the last completed order
    assert (people["u2"].value_segment, one.value_segment) == ("Low", "Mid-Low")
    summary = by(customers.ltv_segment_summary(shop.customer_level), "value_segment", "customers", "gmv")
    assert summary["High"] == (0, 0.0) and summary["Low"] == (1, 9.0)


def test_totals_agree(shop):
    gmv = lambda df, c: df.agg(F.sum(c)).first()[0]
    total = gmv(shop.completed_items, "item_gmv")
    assert total == gmv(shop.completed_orders, "order_gmv") == gmv(shop.customer_agg, "total_gmv")
    assert total == gmv(shop.category_summary, "gmv") == gmv(shop.seller_base, "gmv") == gmv(shop.monthly, "gmv")
    assert total == gmv(marts.state_summary(shop.completed_orders), "gmv")
    assert total == gmv(marts.route_summary(shop.completed_items), "gmv")


def _orders(spark, data, columns="customer_unique_id string, order_id string, ts string, order_gmv decimal(10,2)"):
    df = spark.createDataFrame([(*d[:3], Decimal(d[3]), *d[4:]) for d in data], columns)
    return df.withColumn("order_purchase_timestamp", F.col("ts").cast("timestamp_ntz")).withColumn(
        "purchase_month", F.trunc(F.to_date("ts"), "MM")
    )


def test_mix_and_cohorts(spark):
    orders = _orders(
        spark,
        [
            ("a", "1", "2016-12-01 00:00:00", 1), ("a", "2", "2016-12-01 00:00:00", 1),
            ("a", "3", "2017-03-01 00:00:00", 1), ("b", "4", "2017-01-01 00:00:00", 1), ("c", "5", "2017-03-09 00:00:00", 1),
        ],
    )
    mix = by(growth.monthly_customer_mix(orders), "purchase_month", "active_customers", "new_customers",
             "repeat_orders", "total_orders", "returning_customer_proxy")
    assert mix[date(2016, 12, 1)] == (1, 1, 1, 2, 0)
    assert mix[date(2017, 3, 1)] == (2, 1, 1, 2, 1)
    sequence = by(growth.order_sequence(orders, ranges=3), "order_id", "order_rank", "is_new_order", "is_repeat_order")
    assert sequence == {"1": (1, 1, 0), "2": (2, 0, 1), "3": (3, 0, 1), "4": (1, 1, 0), "5": (1, 1, 0)}
    grid = {(r.cohort_month, r.cohort_index): (r.customers, r.retention) for r in growth.cohort_retention(orders).collect()}
    assert len(grid) == 4 + 3 + 1
    assert grid[date(2016, 12, 1), 3] == (1, 1.0) and grid[date(2016, 12, 1), 2] == (0, 0.0)
    assert grid[date(2017, 3, 1), 0] == (1, 1.0)
    table_ = growth.cohort_heatmap(growth.cohort_retention(orders), min_size=1)
    assert by(table_, "cohort", "m1", "m3", "m4")["2016-12-01"] == ("0.00%", "100.00%", "")


def test_growth_summary(spark):
    monthly = spark.createDataFrame(
        [(date(2017, m, 1), Decimal(g), n) for m, g, n in [(1, 5, 1), (2, 10, 100), (3, 30, 100), (4, 30, 100), (5, 20, 100), (6, 1, 100)]],
        "purchase_month date, gmv decimal(10,2), orders int",
    )
    row = growth.growth_summary(monthly).first()
    assert (row.peak_month, row.first_month, row.last_month, row.gmv_growth) == (
        date(2017, 3, 1), date(2017, 2, 1), date(2017, 5, 1), 1.0,
    )


def test_review_rounding(spark):
    scores = [1.5, 2.5, 3.5, 4.5, 5.0, 0.2, None]
    orders = spark.createDataFrame([(s, 0) for s in scores], "review_score double, is_late_delivery int")
    counts = by(logistics.review_distribution(orders), "review_score_rounded", "orders")
    assert counts == {1: (1,), 2: (2,), 3: (0,), 4: (2,), 5: (1,)}


def test_review_box(spark):
    orders = spark.createDataFrame([(float(s), 0) for s in [1, 4, 4, 5, 5, 5, 5]], "review_score double, is_late_delivery int")
    box = logistics.review_box_stats(orders).first()
    assert (box.q1, box.median, box.q3, box.whisker_low, box.whisker_high) == (4.0, 5.0, 5.0, 4.0, 5.0)


def _distance_expected(values, tiles):
    size, extra = divmod(len(values), tiles)
    result, at = {}, 0
    for tile in range(tiles):
        n = size + (tile < extra)
        part = values[at : at + n]
        at += n
        if part:
            result[tile + 1] = tuple(sum(v[i] for v in part) / len(part) for i in range(3))
    return result


@pytest.mark.parametrize("n", [0, 3, 23, 400])
@pytest.mark.parametrize("kind", ["spread", "identical", "hot"])
def test_distance_tiles(spark, n, kind):
    make = {
        "spread": lambda i: (float(i * 7 % 31), i % 5, float(i % 3)),
        "identical": lambda i: (4.0, 2, 3.0),
        "hot": lambda i: (4.0, 2, 3.0) if i % 3 else (float(i % 11), i % 2, 1.0),
    }[kind]
    values = sorted(make(i) for i in range(n))
    df = spark.createDataFrame(
        [(k, Decimal(f), s) for k, f, s in values] + [(None, Decimal(1), 1.0)],
        "distance_km double, freight_value decimal(10,2), review_score double",
    )
    result = by(marts.distance_summary(df, collect_rows=20, sample_rows=30), "distance_bucket",
                "avg_distance_km", "avg_freight", "avg_review")
    expected = _distance_expected([(k, float(f), s) for k, f, s in values], 5)
    assert sorted(result) == sorted(expected)
    for tile, numbers in expected.items():
        assert result[tile] == pytest.approx(numbers)


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(Decimal(5),)] * 3, "realized_ltv decimal(10,2)")
    bins = by(customers.ltv_histogram(df), "bin", "customers", "bin_start")
    assert len(bins) == 60 and bins[30][0] == 3 and bins[0][1] == 4.5


def test_seller_ties_and_zero_total(spark):
    df = spark.createDataFrame([("b", Decimal(5)), ("a", Decimal(5)), ("c", Decimal(0))], "seller_id string, gmv decimal(10,2)")
    assert by(marts.seller_summary(df, ranges=2), "seller_id", "seller_rank", "cumulative_gmv_share") == {
        "a": (1, 0.5), "b": (2, 1.0), "c": (3, 1.0),
    }
    zero = spark.createDataFrame([("a", Decimal(0))], "seller_id string, gmv decimal(10,2)")
    assert rows(marts.seller_summary(zero), "cumulative_gmv_share") == [(None,)]


def test_pareto_threshold(spark):
    df = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate([70, 10, 10, 5, 5])], "id int, v decimal(10,2)")
    curve = strategy.pareto_curve(df, "id", "v", ranges=3)
    assert rows(strategy.pareto_threshold_share(curve)) == [(3 / 5,)]


def test_category_strategy_at_the_cutoffs(spark):
    data = [("a", 100, 4.0), ("b", 75, 3.0), ("c", 50, 4.5), ("d", 25, 2.0), ("e", 1, None)]
    df = spark.createDataFrame(
        [(c, Decimal(g), r, 0.1) for c, g, r in data],
        "product_category_name_english string, gmv decimal(10,2), avg_review double, avg_freight_share double",
    )
    assert by(strategy.category_strategy(df), "product_category_name_english", "strategic_action") == {
        "a": ("Invest",), "b": ("Fix",), "c": ("Maintain",), "d": ("Rationalize / Monitor",), "e": ("Maintain",),
    }
    assert rows(marts.fix_categories(df), "product_category_name_english") == [("b",)]


def test_first_orders_fill_from_later_ones(spark):
    orders = _orders(
        spark,
        [("a", "2", "2017-01-01 00:00:00", 10, None, None), ("a", "1", "2017-01-01 00:00:00", 20, None, 3.0),
         ("a", "3", "2017-02-01 00:00:00", 30, 5.0, 9.0)],
        "customer_unique_id string, order_id string, ts string, order_gmv decimal(10,2), review_score double, "
        "estimated_vs_actual_days double",
    )
    first = experiment.first_orders(orders).first()
    assert (first.order_id, first.order_gmv, first.review_score, first.estimated_vs_actual_days) == ("1", 20, 5.0, 3.0)


def test_outcome_window_is_half_open(spark):
    orders = _orders(
        spark,
        [("a", "1", "2018-03-01 00:00:00", 10), ("b", "2", "2018-05-30 00:00:00", 10), ("c", "3", "2018-05-29 23:59:59", 10),
         ("d", "4", "2018-02-28 23:59:59", 10)],
    )
    assert sorted(rows(experiment.outcomes(orders), "customer_unique_id")) == [("a",), ("c",)]


def test_financials(spark):
    people = spark.createDataFrame(
        [("control", 1, 0, 100.0, 40.0), ("control", 0, 0, 0.0, 40.0), ("treatment", 1, 0, 100.0, 40.0),
         ("treatment", 0, 1, 0.0, 40.0), ("treatment", 0, 0, 0.0, 40.0)],
        "variant string, baseline_conversion int, induced_conversion int, future_gmv double, order_gmv double",
    )
    money = rows(experiment.financials(people), "gross_gmv_without_discount", "net_gmv", "discount_cost")
    assert [tuple(round(v, 9) for v in m) for m in money] == [
        (100, 100, 0), (0, 0, 0), (100, 90, 10), (40, 36, 4), (0, 0, 0),
    ]


def test_welch(spark):
    a = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4]
    b = [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.5, 24.2]
    df = spark.createDataFrame([("treatment", v) for v in a] + [("control", v) for v in b] + [("control", None)], "variant string, m double")
    row = experiment.welch_p_values(experiment.welch_test(df, ("m",))).first()
    import statistics as st

    ea, eb = st.variance(a) / 15, st.variance(b) / 15
    assert row.t_statistic == pytest.approx((st.mean(a) - st.mean(b)) / math.sqrt(ea + eb))
    assert row.degrees_of_freedom == pytest.approx((ea + eb) ** 2 / (ea**2 / 14 + eb**2 / 14))
    assert 0 < row.p_value < 0.05
    flat = spark.createDataFrame([("treatment", 1.0)] * 3 + [("control", 1.0)] * 3, "variant string, m double")
    assert rows(experiment.welch_p_values(experiment.welch_test(flat, ("m",))), "p_value") == [(None,)]


def test_rft_summary(spark):
    tx = _orders(
        spark,
        [("a", "1", "2017-01-01 08:00:00", 10), ("a", "2", "2017-01-01 20:00:00", 10), ("a", "3", "2017-01-11 00:00:00", 30),
         ("a", "4", "2017-01-21 00:00:00", 10), ("b", "5", "2017-01-31 09:00:00", 5)],
    )
    assert by(lifetime.rft_summary(tx), "customer_unique_id", "frequency", "recency", "T", "monetary_value") == {
        "a": (2, 20.0, 30.0, 20.0), "b": (0, 0.0, 0.0, 0.0),
    }


def test_top_values_ties_and_missing(spark, monkeypatch):
    monkeypatch.setattr(gmv_model, "TOP_CATEGORIES", 1)
    items = spark.createDataFrame(
        [("b", "SP", "SP", "boleto"), ("a", "SP", "SP", "voucher"), (None, None, "SP", None)],
        "product_category_name_english string, customer_state string, seller_state string, payment_type string",
    )
    grouped = gmv_model.with_groups(items, gmv_model.top_values(items))
    assert sorted(rows(grouped, "category_group", "customer_state_group", F.coalesce("payment_type", F.lit("-")))) == [
        ("a", "SP", "voucher"), ("other", "SP", "bank_slip"), ("other", "other", "-"),
    ]


def test_quality_checks(spark):
    data = raw(
        spark,
        customers=[dict(customer_id="c1"), dict(customer_id="c1"), dict(customer_id=None)],
        orders=[dict(order_id="o1", customer_id="c1"), dict(order_id="o2", customer_id="lost"), dict(order_id="o3")],
    )
    keys = by(quality.primary_key_check(data), "table_name", "dup_groups", "null_keys")
    assert keys["customers"] == (1, 1) and keys["orders"] == (0, 0)
    orphans = {(r.child_table, r.child_column): r.orphans for r in quality.foreign_key_check(data).collect()}
    assert orphans["orders", "customer_id"] == 1 and orphans["order_items", "order_id"] == 0


def test_empty_tables(spark):
    empty = warehouse(spark)
    assert empty.order_fact.count() == 0
    assert empty.customer_level.count() == 0
    assert empty.retention.count() == 0
    assert marts.distance_summary(empty.completed_items).count() == 0
    assert empty.seller_summary.count() == 0


def test_table_helper_types(spark):
    row = table(spark, "orders", [ORDERS[0]]).first()
    assert row.order_purchase_timestamp == datetime(2017, 1, 5, 10)


def test_completed_states(spark):
    states = spark.createDataFrame([(s,) for s in ("delivered", "shipped", "invoiced", "processing", "approved", "created", "unavailable", "canceled", None)], "order_status string")
    assert facts.completed(states).count() == 5 and facts.delivered(states).count() == 1
