"""CSV records with quoted line breaks, read by many tasks per file.

Spark's own multi-line mode gives a whole file to one task. Here the file is read as lines in
ordinary splits. A line starts a record when no quoted cell is open before it. Each line says what state
it leaves behind if it begins outside and if it begins inside a quoted cell; these small functions are
composed inside each split and over the few rows that describe the splits. Most records are one line and
go straight on; only the lines of longer records are grouped.

As in the CSV parsers, only a quote at the start of a cell opens one and the next lone quote closes it: stray
ones in an unquoted cell (5" pipe, size 5") are text. A quoted cell that is still open at the end of a file
and a record of more than ``MAX_RECORD_LINES`` lines within a split raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

MAX_RECORD_LINES = 10_000
# in lines without their doubled quotes: the cells that a comma ends, and a last cell that stays open
ENDED_CELLS = r'\G(?:"[^"]*+"[^,]*+|(?!")[^,]*+),'
OPEN_CELL = r'^"[^"]*$'
# what follows the cell that is open where the line begins
AFTER_OPEN_CELL = r'(?s)^[^"]*+"[^,]*+,(.*)$'


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.option("lineSep", "\n").text(path).first()
    return "" if row is None else row[0].lstrip("﻿").rstrip("\r")


def _ends_open(cells: Column) -> Column:
    return F.regexp_replace(cells, ENDED_CELLS, "").rlike(OPEN_CELL).cast("int")


def _composed(df: DataFrame, order: WindowSpec) -> DataFrame:
    """``open0`` and ``open1``: the state before each row if the first one begins outside or inside a cell.

    ``end0`` and ``end1`` are what a row makes of either state. A row that makes the same of both decides what
    comes after it; of the others only the parity of those that exchange the states counts.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flip = (F.col("end0") > F.col("end1")).cast("int")
    df = df.withColumns({"flips": F.sum(flip).over(until), "earlier": F.coalesce(F.sum(flip).over(before), F.lit(0))})
    decided = F.when(F.col("end0") == F.col("end1"), F.col("end0") + F.col("flips"))
    df = df.withColumn("decided", F.last(decided, ignorenulls=True).over(before))
    state = {f"open{n}": (F.coalesce("decided", F.lit(n)) + F.col("earlier")) % 2 for n in (0, 1)}
    return df.withColumns(state).drop("flips", "earlier", "decided")


def read_records(spark: SparkSession, path: str, max_lines: int = MAX_RECORD_LINES) -> DataFrame:
    """One row per CSV record (``record``) without the header record of each file."""
    bare = F.replace("value", F.lit('""'), F.lit(""))
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            F.col("value"),
        )
        .withColumn("end0", _ends_open(bare))
        .withColumn("end1", F.when(~bare.contains('"'), 1).otherwise(_ends_open(F.regexp_extract(bare, AFTER_OPEN_CELL, 1))))
    )
    # a split is at most spark.sql.files.maxPartitionBytes long, so these windows are bounded
    split = Window.partitionBy("file", "block").orderBy("line")
    until = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = _composed(lines, split)
    counted = local.withColumn("row", F.row_number().over(split))
    for n in (0, 1):
        starts = F.when(F.col(f"open{n}") == 0, F.col("row"))
        counted = counted.withColumns({f"starts{n}": F.count(starts).over(until), f"begun{n}": F.max(starts).over(until)})
    # per split: does it begin inside a record, and how many records start before it
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def left(n: int) -> Column:
        return F.max_by(F.when(F.col(f"open{n}") == 0, F.col("end0")).otherwise(F.col("end1")), "line").alias(f"end{n}")

    splits = local.groupBy("file", "block").agg(
        left(0), left(1), F.sum(1 - F.col("open0")).alias("starts0"), F.sum(1 - F.col("open1")).alias("starts1")
    )
    splits = _composed(splits, order).withColumnRenamed("open0", "inside").withColumn("next", F.lead("block").over(order))
    inside = F.col("inside") == 1
    unclosed = F.col("next").isNull() & (F.when(inside, F.col("end1")).otherwise(F.col("end0")) == 1)
    error = F.raise_error(F.concat(F.col("file"), F.lit(": a quoted cell does not end"))).cast("int")
    splits = splits.withColumn("starts", F.when(inside, F.col("starts1")).otherwise(F.col("starts0"))).select(
        "file",
        "block",
        F.when(unclosed, error).otherwise(F.col("inside")).alias("inside"),
        F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("records_before"),
    )

    def here(name: str) -> Column:
        return F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    length = F.col("row") - F.coalesce(here("begun"), F.lit(1)) + 1
    error = F.raise_error(F.concat(F.col("file"), F.lit(f": a record of more than {max_lines} lines"))).cast("long")
    numbered = counted.join(splits, ["file", "block"]).select(
        "file",
        "block",
        "line",
        "value",
        F.when(length > max_lines, error).otherwise(F.col("records_before") + here("starts")).alias("number"),
        (here("open") == 0).alias("is_start"),
        "end0",
    )
    data = numbered.where(F.col("number") > 1)  # number 1 is the header of its file
    complete = F.col("is_start") & (F.col("end0") == 0)
    single = data.where(complete & (F.rtrim("value") != "")).select(F.col("value").alias("record"))
    part = F.struct("block", "line", "value")
    joined = (
        data.where(~complete)
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    )
    return single.unionByName(joined).select(F.regexp_replace("record", "\r$", "").alias("record"))
