"""Exact quantiles per key, also for keys with very many distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAND_WIDTH = 100


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    band_width: int = BAND_WIDTH,
) -> DataFrame:
    """Count, minimum, linearly interpolated quantiles, maximum and mean of `value` per key.

    Equal values are counted before they travel. A key's values are split into bands of
    `band_width`, so a value's rank is the count of the bands below plus its rank within its own
    band: a key with a large share of the rows is worked on by as many tasks as it has bands.
    """
    # One struct as key: its fields may be null and still join and share a partitioning.
    # The band is filtered here, because the join below would infer that filter for one of its
    # sides only and the counting would then run twice instead of being shared.
    counted = (
        df.select(
            F.struct(*keys).alias("_key"),
            F.floor(F.col(value) / band_width).alias("_band"),
            F.col(value).alias("_v"),
        )
        .where("_v is not null and _band is not null")
        .groupBy("_key", "_band", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    per_key = W.partitionBy("_key")
    below = per_key.orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    bands = (
        counted.groupBy("_key", "_band")
        .agg(F.sum("_n").alias("_in_band"))
        .select(
            "_key",
            "_band",
            F.coalesce(F.sum("_in_band").over(below), F.lit(0)).alias("_below"),
            F.sum("_in_band").over(per_key).alias("_total"),
        )
    )
    within = (
        W.partitionBy("_key", "_band")
        .orderBy("_v")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = (
        counted.withColumn("_rank", F.sum("_n").over(within))
        .join(bands, ["_key", "_band"])
        .withColumn("_rank", F.col("_rank") + F.col("_below"))
    )

    def position(p: float):
        return F.lit(p) * (F.col("_total") - 1)

    marks = []
    for name, p in quantiles.items():
        for end, at in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            marks.append(F.min(F.when(F.col("_rank") > at, F.col("_v"))).alias(f"_{name}_{end}"))
    summed = ranked.groupBy("_key").agg(
        F.max("_total").alias("_total"),
        F.min("_v").alias("minimo"),
        F.max("_v").alias("maximo"),
        F.sum(F.col("_v") * F.col("_n")).alias("_sum"),
        *marks,
    )

    def interpolated(name: str, p: float):
        lo, hi = (F.col(f"_{name}_{end}").cast("double") for end in ("lo", "hi"))
        at = position(p)
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return summed.select(
        "_key.*",
        F.col("_total").alias("muestras"),
        F.col("minimo").cast("double").alias("minimo"),
        *[interpolated(name, p) for name, p in quantiles.items()],
        F.col("maximo").cast("double").alias("maximo"),
        (F.col("_sum").cast("double") / F.col("_total")).alias("promedio"),
    )
