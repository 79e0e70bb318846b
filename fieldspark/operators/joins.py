"""Joins Spark has no direct scalable form for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL `column NOT IN (SELECT other_column FROM other)`, with its null rules.

    Spark's own plan for NOT IN ships the whole subquery to every executor. Here the keys meet in
    an ordinary anti join, which Spark shuffles when they are large, and the null rules are two
    scalar subqueries of one row each: an empty subquery keeps every row, a null in the subquery keeps none, and
    otherwise a null `column` is dropped. The keys are reduced once, null included; whether a key is
    null is an aggregate, so no filter on it goes below and all uses can share one exchange.
    """
    key = F.col(other_column)
    keys = other.groupBy(key.alias("_key")).agg(F.max(key.isNull()).alias("_null"))
    present = keys.where(~F.col("_null")).select("_key")
    empty = ~keys.where(F.col("_null").isNotNull()).exists()
    has_null = keys.where("_null").exists()
    allowed = df.where((F.col(column).isNotNull() | empty) & ~has_null)
    return allowed.join(present, F.col(column) == F.col("_key"), "left_anti")


def in_keys(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL `column IN (SELECT other_column FROM other)`."""
    keys = other.select(F.col(other_column).alias("_key")).distinct()
    return df.join(keys, F.col(column) == F.col("_key"), "left_semi")
