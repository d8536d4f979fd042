"""Small raw tables for edge cases; columns that a test does not name are NULL."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import types as T

from stallwise.sources.schemas import SCHEMAS, RawTables
from stallwise.warehouse import Warehouse


def _value(value, kind):
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    return value


def table(spark, name, rows):
    schema = SCHEMAS[name]
    data = [tuple(_value(row.get(f.name), f.dataType) for f in schema.fields) for row in rows]
    return spark.createDataFrame(data, schema)


def raw(spark, **rows) -> RawTables:
    return RawTables(**{name: table(spark, name, rows.get(name, [])) for name in SCHEMAS})


def warehouse(spark, **rows) -> Warehouse:
    return Warehouse(raw(spark, **rows))
