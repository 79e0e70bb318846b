"""Plant weight samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.rules import ratio
from fieldspark.operators.asof import asof_join
from fieldspark.operators.frames import dealt, first_per_key, merged, where_equal
from fieldspark.operators.quantiles import distribution
from fieldspark.sources.tables import Tables


def weight_samples(t: Tables, llave: str | None = None) -> DataFrame:
    """Samples of a block, or of all."""
    return where_equal(t.pesoplanta, llave=llave)


def weight_distribution(t: Tables, llave: str | None = None) -> DataFrame:
    """Count, minimum, quartiles, maximum and mean of the samples per block and day."""
    quartiles = {"q1": 0.25, "mediana": 0.5, "q3": 0.75}
    return distribution(weight_samples(t, llave), ["llave", "fecha"], "valor", quartiles)


def daily_weights(t: Tables, of_blocks: DataFrame | None = None) -> DataFrame:
    """Sum and number of samples per block and day, the form in which weights travel.

    `of_blocks` (one column `llave`) limits the samples to some blocks. Samples are dealt by block and day before
    they are summed, unless they lie in buckets of blocks.
    """
    samples = t.pesoplanta
    if of_blocks is not None:
        samples = samples.join(of_blocks.distinct(), "llave", "left_semi")
    if not t.co_located:
        samples = dealt(samples, "llave", "fecha", rows=t.pesoplanta.count())
    return samples.groupBy("llave", "fecha").agg(
        F.sum("valor").alias("suma"), F.count("valor").alias("n")
    )


def weights_by_day(t: Tables) -> DataFrame:
    """Mean plant weight per block and day."""
    mean = ratio(F.col("suma"), F.col("n"))
    return daily_weights(t).select("llave", "fecha", mean.alias("peso_planta"))


def latest_weight(t: Tables, of_blocks: DataFrame | None = None) -> DataFrame:
    """The last sampling day of each block, or of those in `of_blocks`, and its mean weight in grams.

    A sampling without a date counts as the last one, as in a descending PostgreSQL sort.
    """
    days = daily_weights(t, of_blocks)
    if not t.co_located:
        days = dealt(days, "llave", rows=t.pesoplanta.count())  # a block has a row a day, so none is heavy
    last = first_per_key(days, ["llave"], [F.col("fecha").desc_nulls_first()])
    return last.select(
        "llave",
        F.col("fecha").alias("fecha_muestreo"),
        ratio(F.col("suma"), F.col("n")).alias("peso_planta"),
    )


def last_weight_before_induction(t: Tables, of_blocks: DataFrame | None = None) -> DataFrame:
    """Mean weight in kilograms on the last sampling day before flowering induction.

    Blocks not yet induced use their last day. Samples are summed per day and blocks reduced to
    one row before the two meet, so a block with very many samples or rows joins as a few rows.
    """
    limits = t.blocks_desarrollo.groupBy("bloque").agg(
        F.max("finduccion").alias("hasta"),
        F.bool_or(F.col("finduccion").isNull()).alias("abierto"),
    )
    return (
        daily_weights(t, of_blocks)
        .where(F.col("fecha").isNotNull())
        .join(merged(limits, t.blocks_desarrollo.count()), F.col("llave") == F.col("bloque"))
        .where(F.col("abierto") | (F.col("fecha") < F.col("hasta")))
        .groupBy("llave")
        .agg(F.max_by(F.struct("suma", "n"), "fecha").alias("ultimo"))
        .select(
            "llave",
            (ratio(F.col("ultimo.suma"), F.col("ultimo.n")) / 1000).alias("peso_forza"),
        )
    )


def weight_before_treatment(t: Tables) -> DataFrame:
    """Every treatment with the last sampling day of its block before it, and that day's mean weight."""
    treatments = t.aplicaciones.select("bloque", "codigo_cedula", "etapa", "categoria", "fecha")
    days = daily_weights(t).select(
        F.col("llave").alias("bloque"), F.col("fecha").alias("fecha_muestreo"), "suma", "n"
    )
    days = days.withColumn("dia", F.col("fecha_muestreo"))
    found = asof_join(treatments, days, ["bloque"], "fecha", "dia", ["fecha_muestreo", "suma", "n"])
    weight = ratio(F.col("suma"), F.col("n"))
    return found.select(*treatments.columns, "fecha_muestreo", weight.alias("peso_planta"))
