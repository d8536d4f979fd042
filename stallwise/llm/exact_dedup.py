"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after every run of ASCII white space became one space; a null text
counts as empty. The first scan counts rows per (length, hash of the first characters). Only rows whose
length and prefix occur twice or more can have a copy; these keys go into a bitmap of fixed size that is
broadcast, so the second scan hashes the whole content of the surviving rows alone and no text is
shuffled to find them. A bitmap collision only sends a unique row to the full hash.

Groups of any size are combined on the map side. The join back to the rows has an exchange on either
side, so adaptive execution can split a hot group.

Edge cases: of repeated rows (equal id and text) exactly one is kept and all count in ``group_size``; a
null id sorts after every other id, so ``keep_id`` is null only if all ids of a group are; an empty table
gives an empty result; other columns are never read by ``exact_groups`` and pass through ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .base import SPACE, bitmap_of, text_of, with_bit

PREFIX = 256


def normalised(name: str) -> Column:
    return F.regexp_replace(text_of(name), SPACE, " ")


def _keyed(docs: DataFrame, text: str, *others: Column) -> DataFrame:
    norm = docs.select(*others, normalised(text).alias("_norm"))
    return norm.select(
        "*",
        F.char_length("_norm").alias("_length"),
        F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("_prefix"),
    )


def _key() -> Column:
    return F.xxhash64("_length", "_prefix")


def survivors_bitmap(docs: DataFrame, text: str) -> DataFrame:
    """Bitmap over the lengths and prefixes that occur twice or more."""
    counts = _keyed(docs, text).groupBy("_length", "_prefix").agg(F.count("*").alias("_n"))
    counts = materialise(counts, "dedup_counts")
    lengths = counts.groupBy("_length").agg(F.sum("_n").alias("_rows")).filter("_rows > 1").select("_length")
    shared = counts.filter("_n > 1").join(lengths, "_length", "left_semi")
    return materialise(bitmap_of(shared, _key()), "dedup_bitmap")


def _refined(docs: DataFrame, text: str, bitmap: DataFrame, *others: Column) -> DataFrame:
    """The rows with ``_norm`` and whether they survive the length and prefix steps (``_survives``)."""
    return with_bit(_keyed(docs, text, *others), bitmap, _key(), "_survives").drop("_length", "_prefix")


def _groups(rows: DataFrame) -> DataFrame:
    """Per full hash: the row that stays and the number of rows, for two rows or more."""
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), F.col("_id"), F.col("_row"))).alias("_first")
    groups = rows.groupBy("_sha").agg(F.count("*").alias("group_size"), first).filter("group_size > 1")
    return materialise(
        groups.select("_sha", "group_size", F.col("_first._id").alias("_keep_id"), F.col("_first._row").alias("_keep_row")),
        "dedup_groups",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is the hash of the normalised text; without ``digests`` it is null for rows that the
    length and prefix steps already proved unique (their content is not hashed).
    """
    bitmap = survivors_bitmap(docs, text_col)
    refined = _refined(docs, text_col, bitmap, F.col(id_col).alias("_id"))
    sha = F.sha2(F.col("_norm").cast("binary"), 256)
    rows = materialise(
        refined.select(
            "_id",
            "_survives",
            (sha if digests else F.when(F.col("_survives"), sha)).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "dedup_rows",
    )
    suspects = rows.filter("_survives")
    grouped = suspects.join(_groups(suspects), "_sha", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    alone = rows.filter("not _survives").select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return alone.unionByName(grouped)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the copies: the smallest id of each group stays.

    Rows that are unique by length and prefix pass straight through; only the others are written out and
    looked at again, by a row number that survives lost executors because it is part of the written table.
    """
    bitmap = survivors_bitmap(docs, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    refined = _refined(docs, text_col, bitmap, row, F.col(id_col).alias("_id"))
    suspects = materialise(
        refined.filter("_survives").select(
            "_doc", "_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), F.monotonically_increasing_id().alias("_row")
        ),
        "dedup_suspects",
    )
    narrow = suspects.select("_id", "_sha", "_row")
    losers = narrow.join(_groups(narrow), "_sha").filter("_row != _keep_row").select("_row")
    kept = suspects.join(losers, "_row", "left_anti").select("_doc.*")
    return refined.filter("not _survives").select("_doc.*").unionByName(kept)
