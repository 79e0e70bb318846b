"""Lists of the entries of a key, as rows.

A list is the same at every size: one row per key and distinct entry with the number of times it
occurs. Rows of a large key are spread over tasks by their entries. Totals of a key are an aggregate
of their own. Text is made of the rows only for a page that a caller names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(
    df: DataFrame, keys: Sequence[str], item: str, out: str, *, times: str | None = None
) -> DataFrame:
    """The keys, `out` and `veces`. With `times` a row stands for that many rows. A null item is a
    row with 0 times, so a key without any other keeps a row."""
    number = F.sum(F.when(F.col(item).isNotNull(), F.col(times)).otherwise(0)) if times else F.count(item)
    return (
        df.groupBy(*keys, F.col(item).alias(out))
        .agg(number.cast("bigint").alias("veces"))
        .select(*keys, out, "veces")
    )


def totals(df: DataFrame, keys: Sequence[str], sums: Sequence[str], times: str) -> DataFrame:
    """The keys, the summed columns and `entradas`, the number of rows that they stand for."""
    return df.groupBy(*keys).agg(
        *[F.sum(s).alias(s) for s in sums], F.sum(times).cast("bigint").alias("entradas")
    )


def cell_text(
    rows: DataFrame, keys: Sequence[str], item: str, separator: str, out: str
) -> DataFrame:
    """The entries of each key (`item`, and `veces` if there is such a column) as one sorted text,
    null without entries. Each text is one row: for the page that a caller names, not for a whole
    table."""
    times = F.col("veces") if "veces" in rows.columns else F.lit(1)
    listed = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(item).alias("_item"), times.alias("_n")))).alias("_all")
    )
    words = F.expr("flatten(transform(_all, x -> array_repeat(x._item, cast(x._n as int))))")
    words = F.filter(words, lambda x: x.isNotNull())
    return listed.select(
        *keys, F.when(F.size(words) > 0, F.array_join(words, separator)).alias(out)
    )
