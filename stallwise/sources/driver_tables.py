"""Adapter: the star-schema test tables expressed as the nine raw marketplace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RawTables

SOURCE_TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]
UNTRANSLATED = ["Brand#7", "Brand#21"]


def _shift(ts: str, amount: F.Column, unit: str) -> F.Column:
    return F.timestamp_add(unit, amount.cast("int"), F.col(ts))


def _cents(name: str, precision: int) -> F.Column:
    """A DOUBLE with two decimals as DECIMAL, by way of whole cents (a direct cast goes through text)."""
    cents = F.floor(F.col(name) * 100 + 0.5).cast(f"decimal({precision},0)")
    return (cents * F.lit("0.01").cast("decimal(2,2)")).cast(f"decimal({precision},2)")


def load(spark: SparkSession, sf_dir: str) -> RawTables:
    src = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES}
    nation = src["nation"].select("n_nationkey", "n_name")
    customer = src["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")

    customers = customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )
    geolocation = customer.select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        (F.col("c_custkey") % 40 - 30).cast("double").alias("geolocation_lat"),
        (F.col("c_custkey") % 30 - 70).cast("double").alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )
    sellers = src["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.col("n_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )
    part = src["part"]
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_type").alias("product_description_lenght"),
        (F.col("p_partkey") % 6).cast("int").alias("product_photos_qty"),
        (F.col("p_size") * 100).alias("product_weight_g"),
        F.col("p_size").alias("product_length_cm"),
        (F.col("p_partkey") % 20 + 1).cast("int").alias("product_height_cm"),
        F.when(F.col("p_partkey") % 11 != 0, F.lit(10)).alias("product_width_cm"),
    )
    translation = (
        part.where(~F.col("p_brand").isin(UNTRANSLATED))
        .select(
            F.col("p_brand").alias("product_category_name"), F.lower("p_brand").alias("product_category_name_english")
        )
        .distinct()
    )
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    orders = src["orders"].select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(status == "F", "delivered").when(status == "O", "shipped").otherwise("canceled").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        _shift("o_orderdate", key % 48, "HOUR").alias("order_approved_at"),
        F.when(status != "P", _shift("o_orderdate", key % 5 + 1, "DAY")).alias("order_delivered_carrier_date"),
        F.when(status == "F", _shift("o_orderdate", key % 30 + 1, "DAY")).alias("order_delivered_customer_date"),
        _shift("o_orderdate", F.lit(15), "DAY").alias("order_estimated_delivery_date"),
    )
    line = src["lineitem"]
    price = _cents("l_extendedprice", 12)
    order_items = line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        (price * _cents("l_tax", 4)).alias("freight_value"),
    )
    flag = F.col("l_returnflag")
    order_payments = line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(flag == "A", "credit_card").when(flag == "N", "boleto").otherwise("voucher").alias("payment_type"),
        (F.col("l_linenumber") + 1).alias("payment_installments"),
        price.alias("payment_value"),
    )
    return RawTables(
        customers=customers,
        orders=orders,
        products=products,
        sellers=sellers,
        order_items=order_items,
        order_payments=order_payments,
        order_reviews=_reviews(src["orders"]),
        geolocation=geolocation,
        product_category_translation=translation,
    )


def _reviews(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")

    def one(seq: int, score: F.Column, keep: F.Column) -> DataFrame:
        return orders.where(keep).select(
            (key * 10 + seq).alias("review_id"),
            key.alias("order_id"),
            score.cast("int").alias("review_score"),
            F.when(key % 4 == 0, F.lit("ok")).alias("review_comment_title"),
            F.when(key % 3 != 0, F.concat(F.lit('line one,\nsaid "fine" for '), key.cast("string"))).alias(
                "review_comment_message"
            ),
            _shift("o_orderdate", F.lit(20), "DAY").alias("review_creation_date"),
            _shift("o_orderdate", F.lit(22), "DAY").alias("review_answer_timestamp"),
        )

    return one(0, key % 5 + 1, key % 10 != 0).unionByName(one(1, F.lit(5), key % 13 == 0))
