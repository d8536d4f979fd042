"""Shared helpers: white space, words, tables of a folder, Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
# texts are long rows: a Python worker holds this many of them at once
TEXTS_PER_BATCH = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between runs of ASCII white space; an empty array for a blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def small_batches(spark: SparkSession, rows: int = TEXTS_PER_BATCH) -> None:
    """Bound the Arrow batches of the session, so that very long texts do not meet in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


# a broadcast bitmap of fixed size: 2**27 bits are 16 MB, whatever the input
BITMAP_BITS = 1 << 27
_BITS_PER_ROW = 32768  # of Spark's bitmap functions


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(BITMAP_BITS))


def bitmap_of(keys: DataFrame, key: Column) -> DataFrame:
    """Rows (_bucket, _bits) of a bitmap over a column of 64-bit hashes; at most 4,096 rows of 4 kB."""
    slots = keys.select(_slot(key).alias("_slot"))
    buckets = slots.select(
        F.expr(f"cast(_slot div {_BITS_PER_ROW} as int)").alias("_bucket"),
        F.expr(f"cast(_slot % {_BITS_PER_ROW} as int)").alias("_position"),
    )
    return buckets.groupBy("_bucket").agg(F.bitmap_construct_agg("_position").alias("_bits"))


def with_bit(df: DataFrame, bitmap: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with a boolean column: the key's bit is set. Unset proves that the key is not in the bitmap."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    slots = df.select("*", _slot(key).alias("_slot"))
    slots = slots.select("*", F.expr(f"cast(_slot div {_BITS_PER_ROW} as int)").alias("_bucket"))
    joined = slots.join(F.broadcast(bitmap), "_bucket", "left")
    place = f"cast(_slot % {_BITS_PER_ROW} as int)"
    byte = f"cast(conv(hex(substring(_bits, {place} div 8 + 1, 1)), 16, 10) as int)"
    return joined.select(*columns, F.expr(f"coalesce(shiftright({byte}, {place} % 8) & 1, 0) = 1").alias(name))
