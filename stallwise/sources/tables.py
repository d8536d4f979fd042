"""Reading and writing the raw tables: CSV ingest, append, rebuild, relation reads."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .multiline import first_line, read_records
from .schemas import CSV_FILES, SCHEMAS, RawTables

# Cell texts that the loader takes as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# only these tables hold free text with line breaks
MULTILINE_TABLES = frozenset({"order_reviews"})
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
JDBC_BATCH_ROWS = 10_000


def read_csv_table(
    spark: SparkSession, path: str, table: str, schema: T.StructType | None = None, bad_rows: str = "FAIL"
) -> DataFrame:
    """Read one CSV with its declared schema.

    Cells are read as text, missing markers become NULL, and each column is cast to its declared
    type. ``bad_rows``: "FAIL" raises on a cell that cannot be cast, "NULL" keeps the row with a
    NULL cell.
    """
    target = schema or SCHEMAS[table]
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in target.fields])
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST" if bad_rows == "FAIL" else "PERMISSIVE"}
    if table in MULTILINE_TABLES:
        header = first_line(spark, path).replace('"', "").split(",")
        if header != target.fieldNames():
            raise ValueError(f"{path}: header {header} does not match {target.fieldNames()}")
        records = read_records(spark, path)
        raw = records.select(F.from_csv("record", as_text.toDDL(), options).alias("r")).select("r.*")
    else:
        raw = spark.read.schema(as_text).options(header=True, enforceSchema=False, encoding="UTF-8", **options).csv(path)

    def typed(field: T.StructField) -> F.Column:
        cell = F.when(~F.col(field.name).isin(*MISSING_TEXTS), F.col(field.name))
        if isinstance(field.dataType, T.StringType):
            return cell.alias(field.name)
        if isinstance(field.dataType, T.IntegerType):
            # a column with missing cells may arrive as "40.0"
            cell = F.regexp_replace(cell, r"\.0+$", "")
        kind = field.dataType.simpleString()
        return (cell.cast(kind) if bad_rows == "FAIL" else cell.try_cast(kind)).alias(field.name)

    return raw.select(*[typed(f) for f in target.fields])


def ingest_csv(
    spark: SparkSession,
    folder: str,
    files: Mapping[str, str] | None = None,
    schemas: Mapping[str, T.StructType] | None = None,
    bad_rows: str = "FAIL",
) -> RawTables:
    """The nine CSV files of ``folder`` as typed tables; nothing passes through the driver."""
    names = files or CSV_FILES
    kinds = schemas or SCHEMAS
    return RawTables(
        **{t: read_csv_table(spark, f"{folder}/{names[t]}", t, kinds[t], bad_rows) for t in names}
    )


def write_csv_tables(raw: RawTables, folder: str, files: Mapping[str, str] | None = None) -> None:
    names = files or CSV_FILES
    for table, df in raw.items():
        (
            df.write.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("timestampNTZFormat", TIMESTAMP_FORMAT)
            .csv(f"{folder}/{names[table]}")
        )


def write_table(df: DataFrame, path: str, mode: str = "append", by: Sequence[str] = ()) -> None:
    """Append ``df`` to the table at ``path``; write tasks run in parallel.

    With ``by`` the table has a folder per value of these columns. Overwriting then replaces the folders
    that ``df`` has rows for, say one month, and leaves the others.
    """
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str]) -> None:
    df.write.mode("append").option("batchsize", JDBC_BATCH_ROWS).jdbc(url, table, properties=dict(properties))


def read_jdbc(
    spark: SparkSession, url: str, relation: str, column: str, bounds: tuple[int, int], parts: int, properties
) -> DataFrame:
    return spark.read.jdbc(
        url, relation, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts,
        properties=dict(properties),
    )


def rebuild_tables(raw: RawTables, folder: str) -> RawTables:
    """Replace all nine tables under ``folder``.

    All nine are written to a staging folder first and take the place of the old ones by renaming, so a
    load that fails leaves the old tables as they were, and ``raw`` may read from ``folder`` itself. An old
    table is renamed into the staging folder before the new one takes its place, and back if that fails; it is
    deleted when all nine are in place, so no table is lost at any point.
    """
    spark = raw.orders.sparkSession
    staged = f"{folder}/_staged-{uuid.uuid4().hex[:12]}"
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for table, df in raw.items():
            df.write.parquet(f"{staged}/{table}")
    except Exception:
        files.delete(path_of(staged), True)
        raise
    fresh = {}
    for table, df in raw.items():
        target = f"{folder}/{table}"
        aside = path_of(f"{staged}/old-{table}")
        had = files.exists(path_of(target))
        if had and not files.rename(path_of(target), aside):
            raise OSError(f"{target}: not replaced; the new table is in {staged}")
        if not files.rename(path_of(f"{staged}/{table}"), path_of(target)):
            if had:
                files.rename(aside, path_of(target))
            raise OSError(f"{target}: not replaced; the new table is in {staged}")
        fresh[table] = spark.read.schema(df.schema).parquet(target)
    files.delete(path_of(staged), True)
    return RawTables(**fresh)


def read_tables(spark: SparkSession, folder: str) -> RawTables:
    return RawTables(**{t: spark.read.parquet(f"{folder}/{t}") for t in SCHEMAS})


def read_relation(spark: SparkSession, query: str) -> DataFrame:
    """A query or the name of a registered view as a DataFrame."""
    return spark.sql(query) if " " in query.strip() else spark.table(query.strip())
