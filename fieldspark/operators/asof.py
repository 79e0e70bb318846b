"""As-of join: to each row the last row of another table before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.operators.frames import dealt


def _times(rows: DataFrame, on: Sequence[str], time: str, span: str, side: int, value: Column) -> DataFrame:
    known = F.col(time).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    return rows.where(known).groupBy(*on, F.col(time).alias("_time")).agg(value.alias("_value")).withColumns(
        {"_side": F.lit(side), "_span": F.date_trunc(span, "_time")}
    )


def last_within_span(both: DataFrame, on: Sequence[str]) -> DataFrame:
    """Carries the last value forward within each key and span of time."""
    before = W.partitionBy(*on, "_span").orderBy("_time", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("_carried", F.last("_value", ignorenulls=True).over(before))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    carry: Sequence[str],
    strict: bool = True,
    span: str = "month",
) -> DataFrame:
    """All rows and columns of `left`, with `carry` of the row of `right` that has the same `on` columns and the
    greatest `right_time` before `left_time` (`strict`), or up to it.

    Rows of `right` at one time count as one, that with the greatest `carry` values. Rows without a key or a
    time find nothing and are not found. Names in `carry` must not occur in `left`.

    Both sides are first reduced to one row per key and time, so many rows of a key at one time cost
    nothing here and meet their match in an ordinary join, which Spark can split. The times of a key are cut into spans
    (`date_trunc` units): values are carried forward within each, and what a span ends with is carried to the later
    ones over one row per key and span. So no task needs all times of a key. A `right` of many rows should be
    `dealt` by `on` and `right_time`; `left` is here.
    """
    if clash := set(carry) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    found = F.max(F.struct(*[F.col(c).alias(c) for c in carry]))
    asked = _times(dealt(left.select(*on, left_time), *on, left_time), on, left_time, span, 0 if strict else 1, F.first(F.lit(None)).cast(_kind(right, carry)))
    there = _times(right.select(*on, right_time, *carry), on, right_time, span, 1 if strict else 0, found)
    asks = 0 if strict else 1

    both = asked.unionByName(there)
    ends = both.groupBy(*on, "_span").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_time"))).alias("_end"))
    earlier = W.partitionBy(*on).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.withColumn("_start", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")

    carried = last_within_span(both, on).where(F.col("_side") == asks)
    matches = carried.join(starts, [*on, "_span"], "left").select(
        *on, F.col("_time").alias(left_time), F.coalesce("_carried", "_start").alias("_match")
    )
    out = left.join(matches.where("_match is not null"), [*on, left_time], "left")
    return out.select(*[left[c] for c in left.columns], *[F.col(f"_match.`{c}`").alias(c) for c in carry])


def _kind(right: DataFrame, carry: Sequence[str]) -> str:
    return right.select(F.struct(*[F.col(c).alias(c) for c in carry]).alias("s")).schema["s"].dataType.simpleString()
