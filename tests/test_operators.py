"""Exact ranks, tiles, quantiles and running totals against built-in single-task windows."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stallwise.operators.cuts import cut_points, exact_quantiles, tile_starts, with_ntile
from stallwise.operators.running import with_running
from stallwise.workspace import materialise

TINY = {"collect_rows": 40, "sample_rows": 60}


def _frame(spark, values):
    rows = [(f"id{i:05d}", None if v is None else Decimal(v)) for i, v in enumerate(values)]
    return materialise(spark.createDataFrame(rows, "id string, v decimal(12,2)").repartition(7), "test")


def _cases():
    rng = random.Random(5)
    return {
        "spread": [rng.randrange(10_000) for _ in range(2_503)],
        "one key": [7] * 1_001,
        "hot key": [50] * 700 + [rng.randrange(100) for _ in range(1_400)],
        "nulls": [None] * 333 + [rng.randrange(9) for _ in range(668)],
        "fewer than tiles": [3, 1, 2],
        "single": [5],
        "empty": [],
    }


CASES = _cases()


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("tiles", [4, 5])
def test_ntile(spark, case, tiles):
    df = _frame(spark, CASES[case])
    order = [F.col("v").asc_nulls_last(), F.col("id")]
    expected = {r["id"]: r["t"] for r in df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*order))).collect()}
    actual = {r["id"]: r["t"] for r in with_ntile(df, ["v", "id"], tiles, "t", **TINY).collect()}
    assert actual == expected


def test_ntile_needs_no_shuffle_of_the_rows(spark):
    df = _frame(spark, CASES["spread"])
    plan = with_ntile(df, ["v", "id"], 4, "t", **TINY)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("case", ["spread", "one key", "hot key", "single"])
def test_quantiles(spark, case):
    df = _frame(spark, CASES[case])
    probabilities = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    expected = np.quantile(np.array(CASES[case], dtype=float), probabilities)
    assert np.allclose(exact_quantiles(df, "v", probabilities, **TINY), expected)


def test_quantiles_without_values(spark):
    assert exact_quantiles(_frame(spark, [None, None]), "v", [0.5]) == [None]


def test_cut_counts_equal_rows(spark):
    cut = cut_points(_frame(spark, [1] * 10 + [2] * 500 + [3] * 10), ["v"], [100], **TINY)[100]
    assert (cut.key, cut.below, cut.equal) == ((Decimal("2.00"),), 10, 500)


def test_tile_starts():
    assert tile_starts(10, 4) == [4, 7, 9]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("ranges", [1, 6])
def test_running_total(spark, case, ranges):
    df = _frame(spark, CASES[case])
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    window = Window.orderBy(*order)
    expected = df.withColumn("row_rank", F.row_number().over(window).cast("bigint")).withColumn(
        "running_total",
        F.sum(F.coalesce("v", F.lit(0))).over(window.rowsBetween(Window.unboundedPreceding, 0)),
    )
    actual = with_running(df, order, total="v", ranges=ranges)
    assert sorted(actual.collect()) == sorted(expected.select(actual.columns).collect())


@pytest.mark.parametrize("ranges", [1, 9])
def test_rank_within_groups_that_span_ranges(spark, ranges):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice([None, "a", "b", "c"]), rng.randrange(50), i) for i in range(1_500)]
    df = materialise(spark.createDataFrame(rows, "g string, t int, id int"), "test")
    order = [F.col("t").asc(), F.col("id").asc()]
    window = Window.partitionBy("g").orderBy(*order)
    expected = {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(window)).collect()}
    actual = {r["id"]: r["n"] for r in with_running(df, order, within=["g"], rank="n", ranges=ranges).collect()}
    assert actual == expected


def test_groups_are_combined_before_the_shuffle_on_the_key(spark):
    from stallwise.operators import grouping

    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i % 4, i) for i in range(900)]
    df = materialise(spark.createDataFrame(rows, "k string, c int, v int"), "test")
    combined = grouping.combined_on(df, "k", lambda d: d.groupBy("k", "c").agg(F.sum("v").alias("v")))
    expected = df.groupBy("k", "c").agg(F.sum("v").alias("v"))
    assert sorted(combined.collect()) == sorted(expected.collect())
    # one shuffle of partial sums, one of the combined rows; further grouping within the key needs none
    plan = combined.groupBy("k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.rindex("partial_sum") > plan.rindex("Exchange")


def test_quantiles_leave_out_nan_whatever_the_size(spark):
    for rows in (2_000, 6_000):
        values = [float(i) for i in range(rows)]
        df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),)] * 2 + [(None,)], "v double")
        df = materialise(df, "test")
        for limit in (50_000, 50):
            found = exact_quantiles(df, "v", [0.0, 0.5, 0.9], collect_rows=limit)
            assert found == pytest.approx(np.quantile(values, [0.0, 0.5, 0.9]).tolist())
