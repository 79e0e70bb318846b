"""Parquet store of the domain tables, and export of result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.markup import markup_text
from fieldspark.sources.schemas import DATED, SCHEMAS
from fieldspark.sources.tables import YEAR_PARTITION, Tables


def write_table(df: DataFrame, name: str, root: str) -> None:
    """Write one table below `root`.

    Dated tables are range-partitioned by date and block before the write: a busy date is split
    by block, every file covers few dates, so row-group statistics skip the rest, and each
    file belongs to one or two year partitions. Finding the ranges reads the source once more.
    """
    path = f"{root}/{name}"
    if name not in DATED:
        df.write.mode("overwrite").parquet(path)
        return
    spread = [c for c in ("bloque", "llave", "block") if c in df.columns]
    (
        df.withColumn(YEAR_PARTITION, F.year("fecha"))
        .repartitionByRange("fecha", *spread)
        .write.mode("overwrite")
        .partitionBy(YEAR_PARTITION)
        .parquet(path)
    )


def write_tables(tables: Tables, root: str, names: Iterable[str] | None = None) -> None:
    """Copy tables (all by default) from any source into a parquet store below `root`."""
    for name in names or SCHEMAS:
        write_table(getattr(tables, name), name, root)


def export_plain(df: DataFrame) -> DataFrame:
    """`df` with the markup in text columns reduced to its text, as exported tables show it."""
    return df.select(
        *[
            markup_text(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def export_table(df: DataFrame, path: str, format: str = "csv") -> None:
    """Write a result table without markup; CSV gets a header line."""
    writer = export_plain(df).write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def export_files(
    df: DataFrame, path: str, order: Sequence[Column], most_rows: int = 1_000_000, format: str = "csv"
) -> None:
    """Writes a result without markup in files of at most `most_rows` rows (a spreadsheet's, say) in the order of
    `order`: the files by name, and the rows within each. Spark sorts by ranges, so no task has the whole result."""
    ordered = export_plain(df).orderBy(*order)
    writer = ordered.write.mode("overwrite").option("maxRecordsPerFile", most_rows)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a parquet export with `orden`, their place in it from 0. The files before a file are
    counted on the driver, one row a file."""
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    files = rows.groupBy("_file").count().orderBy("_file").collect()
    starts = accumulate((r["count"] for r in files), initial=0)
    files = spark.createDataFrame([(r["_file"], n) for r, n in zip(files, starts, strict=False)], "_file string, _before long")
    return rows.join(F.broadcast(files), "_file").withColumn("orden", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
