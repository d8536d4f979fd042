"""Declared schemas, keys and foreign keys of the nine raw tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXT, INTEGER, TIMESTAMP = T.StringType(), T.IntegerType(), T.TimestampNTZType()
MONEY, COORDINATE = T.DecimalType(10, 2), T.DoubleType()

# Table and column names, types and keys of the raw data contract.
_COLUMNS = {
    "customers": {
        "customer_id": TEXT,
        "customer_unique_id": TEXT,
        "customer_zip_code_prefix": INTEGER,
        "customer_city": TEXT,
        "customer_state": TEXT,
    },
    "products": {
        "product_id": TEXT,
        "product_category_name": TEXT,
        "product_name_lenght": INTEGER,
        "product_description_lenght": INTEGER,
        "product_photos_qty": INTEGER,
        "product_weight_g": INTEGER,
        "product_length_cm": INTEGER,
        "product_height_cm": INTEGER,
        "product_width_cm": INTEGER,
    },
    "sellers": {
        "seller_id": TEXT,
        "seller_zip_code_prefix": INTEGER,
        "seller_city": TEXT,
        "seller_state": TEXT,
    },
    "orders": {
        "order_id": TEXT,
        "customer_id": TEXT,
        "order_status": TEXT,
        "order_purchase_timestamp": TIMESTAMP,
        "order_approved_at": TIMESTAMP,
        "order_delivered_carrier_date": TIMESTAMP,
        "order_delivered_customer_date": TIMESTAMP,
        "order_estimated_delivery_date": TIMESTAMP,
    },
    "order_items": {
        "order_id": TEXT,
        "order_item_id": INTEGER,
        "product_id": TEXT,
        "seller_id": TEXT,
        "shipping_limit_date": TIMESTAMP,
        "price": MONEY,
        "freight_value": MONEY,
    },
    "order_payments": {
        "order_id": TEXT,
        "payment_sequential": INTEGER,
        "payment_type": TEXT,
        "payment_installments": INTEGER,
        "payment_value": MONEY,
    },
    "order_reviews": {
        "review_id": TEXT,
        "order_id": TEXT,
        "review_score": INTEGER,
        "review_comment_title": TEXT,
        "review_comment_message": TEXT,
        "review_creation_date": TIMESTAMP,
        "review_answer_timestamp": TIMESTAMP,
    },
    "geolocation": {
        "geolocation_zip_code_prefix": INTEGER,
        "geolocation_lat": COORDINATE,
        "geolocation_lng": COORDINATE,
        "geolocation_city": TEXT,
        "geolocation_state": TEXT,
    },
    "product_category_translation": {
        "product_category_name": TEXT,
        "product_category_name_english": TEXT,
    },
}
SCHEMAS: dict[str, T.StructType] = {
    table: T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])
    for table, columns in _COLUMNS.items()
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "product_category_translation": ["product_category_name"],
}

# (child table, column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]

# one file, or one folder of part files, per table; pass another map for other names
CSV_FILES: dict[str, str] = {table: f"{table}.csv" for table in SCHEMAS}


@dataclass(frozen=True)
class RawTables:
    """The nine raw tables as DataFrames."""

    customers: DataFrame
    orders: DataFrame
    products: DataFrame
    sellers: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    geolocation: DataFrame
    product_category_translation: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]
