"""Small frame operators shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a task, on average, that groups what `dealt` gives it.
TASK_ROWS = 250_000


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column free."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def free(**values) -> list[str]:
    """Names of the columns left free, which a report keeps as keys."""
    return [name for name, value in values.items() if value is None]


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order.

    Spark limits each key to one row per input partition before the shuffle, so a key that holds
    a large share of the rows reaches its window as a handful of rows.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def fill_blank(df: DataFrame, *keys: str) -> DataFrame:
    """All columns as text, nulls as empty text; `keys` stay as they are."""
    return df.select(
        *[
            F.col(f"`{c}`")
            if c in keys
            else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
            for c in df.columns
        ]
    )


def round_numbers(df: DataFrame, digits: int = 2) -> DataFrame:
    """Fractional columns rounded half up."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, fractional)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """The rows dealt evenly to `per_core` tasks for each core. For costly expressions over a table of few
    bytes, which Spark would read, and work on, in one task."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows dealt to tasks by `keys`, as many tasks as keep them at `TASK_ROWS` rows on average, so that what
    a task needs to group them does not grow with the table. What is grouped by `keys`, with or without further
    columns, needs no further exchange. `rows` is their number, or a bound; left out, they are counted. No more
    rows than one task has stay where they are.
    """
    tasks = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def merged(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is sorted, not broadcast, if `rows` (its number of rows or a bound) are more than
    `TASK_ROWS`. Spark takes a few compressed columns of a long table for small, and each task of a join has the
    whole of what is broadcast to it."""
    return df.hint("merge") if rows > TASK_ROWS else df
