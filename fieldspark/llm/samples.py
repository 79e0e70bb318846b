"""Held-out rows and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(parts: int, part: int, doc_id: str = "doc_id") -> Column:
    """Whether the remainder of crc32(doc_id as text) by ``parts`` is ``part``; a row without doc_id
    is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def fraction(*columns: str) -> Column:
    """A number in [0, 1) that follows from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def bounded_sample(rows: DataFrame, most: int, by: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``by``. Rows are dropped by their hash
    before they are sorted, so about as many as wanted are moved, however many there are."""
    share = 1.5 * most / max(1, rows.count())
    return rows.where(fraction(by) < share).orderBy(fraction(by), *rows.columns).limit(most)


def sample_of_each(rows: DataFrame, by: str, most: int, counts: DataFrame) -> DataFrame:
    """The same for each value of ``by``, of which ``counts`` (by, count) has the numbers."""
    order = Window.partitionBy(by).orderBy(fraction("doc_id"), "doc_id")
    near = rows.join(F.broadcast(counts), by).where(fraction("doc_id") < 1.5 * most / F.col("count")).drop("count")
    return near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
