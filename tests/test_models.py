"""Lifetime models, special functions, order-value model, CSV ingest, views and figures."""

import math
import os
from dataclasses import replace
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.functions.newton import minimise
from stallwise.functions.special import hypergeometric, log_beta, log_gamma
from stallwise.functions.student import two_sided_p
from stallwise.plans import figures, gmv_model, lifetime, views
from stallwise.sources import multiline, tables
from stallwise.warehouse import Warehouse
from stallwise.workspace import materialise, new_path


def test_log_gamma():
    x = np.array([1e-6, 0.01, 0.5, 1.0, 2.5, 40.0, 1e4])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)
    assert log_beta(2.0, 3.0) == pytest.approx(math.log(1 / 12))


def test_hypergeometric():
    # 2F1(1, 1; 2; z) = -ln(1 - z) / z
    z = np.array([0.0, 0.1, 0.9, 0.99])
    expected = [1.0] + [-math.log(1 - v) / v for v in z[1:]]
    assert np.allclose(hypergeometric(1.0, 1.0, 2.0, z), expected, rtol=1e-12)


@pytest.mark.parametrize("t, df, p", [(0.0, 5, 1.0), (2.0, 1, 0.2951672), (2.228139, 10, 0.05), (1.959964, 1e7, 0.05)])
def test_student(t, df, p):
    assert two_sided_p(t, df) == pytest.approx(p, abs=1e-6)


def test_minimise():
    score = lambda points: np.array([(p[0] - 3) ** 2 + 10 * (p[1] + p[0] ** 2) ** 2 for p in points])
    point, value, _ = minimise(score, np.zeros(2))
    assert np.allclose(point, [3, -9], atol=1e-3) and value < 1e-6


def _bgnbd_reference(x, tx, age, theta):
    r, alpha, a, b = theta
    beta = lambda p, q: math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)
    front = math.lgamma(r + x) - math.lgamma(r) + r * math.log(alpha) - beta(a, b)
    branches = [beta(a, b + x) - (r + x) * math.log(alpha + age)]
    if x > 0:
        branches.append(beta(a + 1, b + x - 1) - (r + x) * math.log(alpha + tx))
    top = max(branches)
    return front + top + math.log(sum(math.exp(v - top) for v in branches))


def test_purchase_likelihood():
    x = np.array([0.0, 1.0, 3.0, 200.0])
    tx = np.array([0.0, 10.0, 25.0, 300.0])
    age = np.array([40.0, 40.0, 30.0, 310.0])
    theta = (0.3, 4.0, 0.8, 2.5)
    ours = lifetime.purchase_log_likelihood(x, tx, age, theta)
    assert np.allclose(ours, [_bgnbd_reference(*v, theta) for v in zip(x, tx, age)], rtol=1e-12)
    assert np.isfinite(ours).all()


def _customers(n, r, alpha, a, b, seed=1, age=400.0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        rate, drop = rng.gamma(r, 1 / alpha), rng.beta(a, b)
        now, x, last = 0.0, 0, 0.0
        while True:
            now += rng.exponential(1 / rate)
            if now > age:
                break
            x, last = x + 1, now
            if rng.random() < drop:
                break
        rows.append((float(x), float(last), age, 1.0))
    return rows


def test_purchase_model_recovers_parameters(spark, monkeypatch):
    monkeypatch.setattr(lifetime, "PENALTY", 0.0)
    rows = _customers(6_000, 0.8, 40.0, 0.9, 3.0)
    df = spark.createDataFrame(rows, "frequency double, recency double, T double, weight double")
    model = lifetime.bgnbd_fit(materialise(df.repartition(4), "test"))
    assert model.r == pytest.approx(0.8, rel=0.15)
    assert model.alpha == pytest.approx(40.0, rel=0.2)
    assert model.a / (model.a + model.b) == pytest.approx(0.9 / 3.9, rel=0.15)


def test_spend_model_recovers_parameters(spark, monkeypatch):
    monkeypatch.setattr(lifetime, "PENALTY", 0.0)
    rng = np.random.default_rng(4)
    p, q, v = 6.0, 4.0, 15.0
    x = rng.integers(1, 8, 20_000).astype(float)
    mean = rng.gamma(p * x, 1.0) / rng.gamma(q, 1 / v, len(x)) / x
    df = spark.createDataFrame([(float(a), float(m), 1.0) for a, m in zip(x, mean)], "frequency double, monetary_value double, weight double")
    model = lifetime.gamma_gamma_fit(materialise(df.repartition(4), "test"))
    assert (model.p, model.q, model.v) == pytest.approx((p, q, v), rel=0.15)


def test_expected_purchases():
    model = lifetime.PurchaseModel(r=0.3, alpha=4.0, a=0.8, b=2.5, objective=0.0, iterations=0)
    x, tx, age = np.array([0.0, 2.0, 2.0, 60.0]), np.array([0.0, 30.0, 5.0, 39.0]), np.array([40.0] * 4)
    t = 30.0
    # the published closed form with the plain series
    z = t / (4.0 + age + t)
    f = hypergeometric(0.3 + x, 2.5 + x, 0.8 + 2.5 + x - 1, z)
    top = (0.8 + 2.5 + x - 1) / (0.8 - 1) * (1 - ((4.0 + age) / (4.0 + age + t)) ** (0.3 + x) * f)
    odds = np.where(x > 0, 0.8 / (2.5 + x - 1) * ((4.0 + age) / (4.0 + tx)) ** (0.3 + x), 0.0)
    ours = lifetime.expected_purchases(t, x, tx, age, model)
    assert np.allclose(ours, top / (1 + odds), rtol=1e-8)
    assert ours[1] > ours[2]  # a more recent last purchase means more to come
    assert (lifetime.expected_purchases(0, x, tx, age, model) == 0).all()


def test_predictions(small):
    df = small.predictions
    checked = df.agg(
        F.count("*").alias("n"),
        F.min("frequency").alias("f"),
        F.min("predicted_6m_purchases").alias("low"),
        F.count(F.when(F.isnan("predicted_6m_ltv") | F.col("predicted_6m_ltv").isNull(), 1)).alias("bad"),
    ).first()
    assert checked.n > 0 and checked.f > 0 and checked.low >= 0 and checked.bad == 0
    described = {r.statistic: r for r in lifetime.ltv_describe(df).collect()}
    assert list(described) == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert described["count"].frequency == checked.n


def test_sample_is_exact_and_stable(spark, small):
    items, everyone = small.model_items, small.completed_orders
    orders = items.select("order_id").distinct().count()
    wanted = orders // 3
    ids = lambda df: {r.order_id for r in df.select("order_id").distinct().collect()}
    picked = ids(gmv_model.sampled_items(items, everyone, wanted, collect_rows=30, sample_rows=50))
    assert len(picked) == wanted
    # another layout, and many orders without items
    strangers = spark.range(10**6, 10**6 + 40 * orders).select(F.col("id").alias("order_id"))
    crowd = everyone.select("order_id").unionByName(strangers)
    assert ids(gmv_model.sampled_items(items.repartition(13), crowd, wanted)) == picked
    assert len(ids(gmv_model.sampled_items(items, everyone, orders + 5))) == orders
    # all items of a sampled order are kept
    kept = gmv_model.sampled_items(items, everyone, wanted)
    assert kept.count() == items.where(F.col("order_id").isin(picked)).count()
    split = gmv_model.model_sample_split(gmv_model.model_orders(gmv_model.with_groups(kept, small.top_values)))
    assert split.count() == wanted
    share = split.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.15 < share < 0.35


def test_forest(spark, small):
    sample = small.model_sample
    gap = F.col("order_id") % 7 == 0
    holed = materialise(
        sample.withColumn("avg_weight_g", F.when(~gap, F.col("avg_weight_g")))
        .withColumn("payment_type", F.when(~gap, F.col("payment_type")))
        .withColumn("main_category", F.when(F.col("is_test"), F.lit("never seen")).otherwise(F.col("main_category"))),
        "test",
    )
    model = gmv_model.model_fit(holed, trees=8, depth=6)
    scored = materialise(gmv_model.model_score(model, holed.where("is_test")), "test")
    assert scored.count() == holed.where("is_test").count()
    metrics = {r.metric: r.value for r in gmv_model.model_metrics(scored, holed.count()).collect()}
    assert metrics["R-squared"] > 0.3  # better than the mean
    assert 0 < metrics["Median absolute error"] and metrics["Sampled orders"] == holed.count()
    importance = {r.feature_group: r.importance for r in gmv_model.feature_importance(model, holed).collect()}
    assert set(importance) == set(gmv_model.NUMERIC + gmv_model.CATEGORICAL)
    assert sum(importance.values()) == pytest.approx(1.0)
    assert max(importance, key=importance.get) == "item_count"
    pairs = gmv_model.pred_vs_actual_sample(scored, rows=50)
    assert pairs.count() == 50 and pairs.select("axis_limit").distinct().count() == 1


def _metrics_in_sql(scored) -> dict:
    """The metrics of a written table of scores, by DuckDB."""
    con = duckdb.connect()
    files = [f for f in scored.inputFiles()]
    con.execute("CREATE VIEW scored AS SELECT * FROM read_parquet([" + ", ".join(f"'{f.removeprefix('file://')}'" for f in files) + "])")
    names = ["MAE", "Median absolute error", "R-squared", "Held-out orders"]
    return dict(zip(names, con.execute("""
        SELECT avg(abs(actual - predicted)), quantile_cont(abs(actual - predicted), 0.5),
               1 - sum((actual - predicted) ** 2) / sum((actual - (SELECT avg(actual) FROM scored)) ** 2), count(*)
        FROM scored""").fetchone()))  # fmt: skip


def test_every_held_out_order_is_scored(spark, small, monkeypatch):
    """The bound on the fit leaves no order without a prediction and no error out of the metrics."""
    monkeypatch.setattr(gmv_model, "TREES", 6)
    bounded = Warehouse(small.raw, datetime(1999, 1, 1), fit_orders=300)
    sample = bounded.model_sample
    assert sample.count() == 300
    everyone = gmv_model.model_sample_split(gmv_model.model_orders(bounded.grouped_items))
    wanted = {r.order_id: r.gmv for r in everyone.where("is_test").collect()}
    scored = bounded.model_scored
    rows = scored.collect()
    assert len(wanted) > sample.where("is_test").count()
    assert len(rows) == len(wanted) and {r.order_id: r.actual for r in rows} == wanted
    assert not {r.order_id for r in rows} & {r.order_id for r in sample.where("not is_test").collect()}
    # an order inside the sample gets the prediction of the sample's own features
    again = gmv_model.model_score(bounded.model, sample.where("is_test")).collect()
    assert {tuple(r) for r in again} <= {tuple(r) for r in rows}
    metrics = {r.metric: r.value for r in gmv_model.model_metrics(scored, sample.count()).collect()}
    assert metrics.pop("Sampled orders") == 300
    expected = _metrics_in_sql(scored)
    assert set(metrics) == set(expected)
    assert all(metrics[name] == pytest.approx(expected[name], rel=1e-9) for name in expected)
    points = gmv_model.pred_vs_actual_sample(scored, rows=10**6)
    assert points.count() == len(wanted)


def test_held_out_filter_reaches_the_items(small):
    text = small.held_out_orders._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate") < text.index("split-42") < text.index("Relation")


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def csv_folder(tmp_path):
    header = {t: ",".join(s.fieldNames()) for t, s in tables.SCHEMAS.items()}
    for name, file in tables.CSV_FILES.items():
        _write(tmp_path, file, header[name] + "\n")
    _write(tmp_path, tables.CSV_FILES["product_category_translation"], "﻿" + header["product_category_translation"] + "\nbeleza,health\n")
    _write(
        tmp_path,
        tables.CSV_FILES["order_reviews"],
        header["order_reviews"]
        + '\nr1,o1,5,NA,"two\nlines, a ""quote"" and a comma",2018-01-18 00:00:00,2018-01-18 21:46:59\nr2,o2,4,,null,2018-01-01 00:00:00,\n',
    )
    _write(tmp_path, tables.CSV_FILES["customers"], header["customers"] + "\nc1,u1,01037,sao paulo,SP\nNA,u2,,,\n")
    _write(tmp_path, tables.CSV_FILES["order_items"], header["order_items"] + "\no1,1,p1,s1,2017-09-19 09:45:35,58.90,13.29\n")
    _write(tmp_path, tables.CSV_FILES["products"], header["products"] + "\np1,perfumaria,40.0,287,1,225,16,10,14\n")
    return str(tmp_path)


def test_ingest_csv(spark, csv_folder):
    raw = tables.ingest_csv(spark, csv_folder)
    assert raw.product_category_translation.first()["product_category_name"] == "beleza"
    one, two = raw.order_reviews.orderBy("review_id").collect()
    assert one.review_comment_message == 'two\nlines, a "quote" and a comma' and one.review_comment_title is None
    assert two.review_comment_message is None and two.review_answer_timestamp is None
    assert [tuple(r) for r in raw.customers.orderBy("customer_unique_id").collect()] == [
        ("c1", "u1", 1037, "sao paulo", "SP"),
        (None, "u2", None, None, None),
    ]
    assert str(raw.order_items.first().price) == "58.90"
    assert raw.products.first().product_name_lenght == 40
    assert raw.orders.count() == 0


def test_multiline_records_across_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(2)
    pieces = ["plain", 'say ""x""'.replace('""', '"'), "a,b", "one\ntwo", "\n\n", '"', "é\n", "end"]
    names = tables.SCHEMAS["order_reviews"].fieldNames()
    expected = set()
    for part in range(2):
        with open(tmp_path / f"part{part}.csv", "w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f, lineterminator="\r\n" if part else "\n")
            writer.writerow(names)
            for i in range(400):
                text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5)))
                writer.writerow([f"r{part}-{i}", f"o{i}", i % 5 + 1, "t", text, "2018-01-01 00:00:00", "2018-01-02 00:00:00"])
                expected.add((f"r{part}-{i}", i % 5 + 1, text))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        df = tables.read_csv_table(spark, str(tmp_path), "order_reviews")
        assert df.rdd.getNumPartitions() > 1
        found = {(r.review_id, r.review_score, r.review_comment_message) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == expected


def test_stray_quote_keeps_all_records(spark, tmp_path):
    names = tables.SCHEMAS["order_reviews"].fieldNames()
    rows = [f"r{i},o{i},5,t,{'5\" pipe' if i == 10 else 'fine'},2018-01-01 00:00:00,2018-01-02 00:00:00" for i in range(1000)]
    _write(tmp_path, "reviews.csv", "\n".join([",".join(names), *rows]) + "\n")
    found = {r.review_id: r.review_comment_message for r in tables.read_csv_table(spark, str(tmp_path), "order_reviews").collect()}
    assert len(found) == 1000 and found["r10"] == '5" pipe' and found["r999"] == "fine"


def test_quote_at_the_end_of_an_unquoted_cell_keeps_all_records(spark, tmp_path):
    names = tables.SCHEMAS["order_reviews"].fieldNames()
    odd = {10: 'size 5"', 500: '"two\nlines, 5"" wide"', 700: '5"" or 6"', 701: '"one, 7"""'}
    rows = [f"r{i},o{i},5,t,{odd.get(i, 'fine')},2018-01-01 00:00:00,2018-01-02 00:00:00" for i in range(1000)]
    _write(tmp_path, "reviews.csv", "\n".join([",".join(names), *rows]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, 700):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = {r.review_id: r.review_comment_message for r in tables.read_csv_table(spark, str(tmp_path), "order_reviews").collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(found) == 1000 and found["r10"] == 'size 5"' and found["r999"] == "fine"
        assert found["r500"] == 'two\nlines, 5" wide' and found["r701"] == 'one, 7"'


def test_unclosed_and_endless_records_raise(spark, tmp_path):
    names = tables.SCHEMAS["order_reviews"].fieldNames()
    dates = "2018-01-01 00:00:00,2018-01-02 00:00:00"
    _write(tmp_path, "open.csv", ",".join(names) + f'\nr1,o1,5,t,"open,{dates}\nr2,o2,5,t,x,{dates}\n')
    with pytest.raises(Exception, match="a quoted cell does not end"):
        tables.read_csv_table(spark, f"{tmp_path}/open.csv", "order_reviews", bad_rows="NULL").collect()
    _write(tmp_path, "long.csv", ",".join(names) + '\nr1,o1,5,t,"' + "x\n" * 30 + f'",{dates}\n')
    assert multiline.read_records(spark, f"{tmp_path}/long.csv").count() == 1
    with pytest.raises(Exception, match="more than 20 lines"):
        multiline.read_records(spark, f"{tmp_path}/long.csv", max_lines=20).collect()


def test_failed_rebuild_keeps_the_old_tables(spark, small):
    folder = new_path(spark, "rebuild")
    tables.rebuild_tables(small.raw, folder)
    broken = replace(small.raw, sellers=small.raw.sellers.withColumn("seller_city", F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        tables.rebuild_tables(broken, folder)
    assert tables.read_tables(spark, folder).sellers.count() == small.raw.sellers.count()
    again = tables.rebuild_tables(tables.read_tables(spark, folder), folder)
    assert again.orders.count() == small.raw.orders.count()


def test_ingest_bad_cells(spark, csv_folder):
    header = ",".join(tables.SCHEMAS["sellers"].fieldNames())
    _write(csv_folder, tables.CSV_FILES["sellers"], header + "\ns1,12x,city,SP\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.ingest_csv(spark, csv_folder).sellers.collect()
    kept = tables.ingest_csv(spark, csv_folder, bad_rows="NULL").sellers.first()
    assert (kept.seller_id, kept.seller_zip_code_prefix) == ("s1", None)


def test_write_and_rebuild(spark, small):
    path = new_path(spark, "append")
    tables.write_table(small.raw.sellers, path)
    tables.write_table(small.raw.sellers, path)
    assert spark.read.parquet(path).count() == 2 * small.raw.sellers.count()
    folder = new_path(spark, "rebuild")
    tables.rebuild_tables(small.raw, folder)
    tables.rebuild_tables(small.raw, folder)
    assert tables.read_tables(spark, folder).orders.count() == small.raw.orders.count()
    # nothing that was staged or set aside stays
    assert sorted(os.listdir(folder.removeprefix("file:"))) == sorted(tables.SCHEMAS)


def test_views_and_relations(spark, small):
    names = views.register_views(small)
    assert len(names) == 23
    assert [r.view_name for r in views.list_views(spark).collect() if r.view_name in names] == sorted(names)
    assert tables.read_relation(spark, "vw_monthly_metrics").count() == small.monthly.count()
    query = "SELECT count(*) AS n FROM vw_completed_orders WHERE order_status = 'delivered'"
    assert tables.read_relation(spark, query).first().n == small.delivered_orders.count()


def test_figures(spark, small, monkeypatch):
    monkeypatch.setattr(gmv_model, "TREES", 4)
    stored = figures.export_figures(small, new_path(spark, "figures"))
    assert len({figure for figure, _ in stored}) == 12
    assert all(spark.read.parquet(p).columns for p in stored.values())
