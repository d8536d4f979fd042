"""Written intermediate tables in the shared folder of the cluster.

Anything that must be read more than once (facts, rank input, fitted-model input) is
written as Parquet and read back. That cuts the lineage, survives the loss of executors
and keeps column pruning, which a cached or checkpointed RDD would not.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# what one bucket should hold, and how many of them Spark allows by default
ROWS_PER_BUCKET, MAX_BUCKETS = 1_000_000, 100_000

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _local_dirs:
        # kept until the interpreter ends, then removed
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="stallwise-", ignore_cleanup_errors=True)
    return _local_dirs[app].name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stallwise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader over it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, rows: int) -> int | None:
    """Buckets for a table of so many rows: one per shuffle partition or more; None if too many would be needed."""
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_BUCKET))
    return wanted if wanted <= MAX_BUCKETS else None


def materialise_on(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df``, already partitioned on ``key`` into ``buckets``, as a bucketed table: groupings and joins on
    the key then need no shuffle, and other plans read it like any table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"stallwise_{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def materialise_by(
    df: DataFrame, name: str, column: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """Write ``df`` with a folder per value of ``column``; rows are balanced, so a large value spans several files.

    ``finish`` adds columns to rows that lie where they are written, which keeps those out of the shuffle; it must
    leave ``column`` as it is.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    finished = finish(df.hint("rebalance", column))
    finished.write.partitionBy(column).parquet(path)
    return spark.read.schema(finished.schema).parquet(path).select(*finished.columns)
