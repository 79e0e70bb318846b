"""One planting group, or all of them: blocks, weights and treatments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.dates import spanish_date
from fieldspark.functions.text import block_key, link
from fieldspark.operators.frames import fill_blank, free, where_equal
from fieldspark.operators.joins import in_keys
from fieldspark.operators.lists import entries
from fieldspark.plans.weights import daily_weights
from fieldspark.sources.tables import Tables


def group_list(t: Tables, etapa: str | None = None) -> DataFrame:
    """Groups with their stage and start date, without repeats, oldest first."""
    sources = [
        (t.grupossiembra, "preforza"),
        (t.grupos2dacosecha, "preforza"),
        (t.gruposforza, "postforza"),
        (t.gruposforza2, "postforza"),
        (t.grupossemillero, "semillero"),
    ]
    tagged = [
        df.select(
            F.col("descripcion").alias("label"),
            F.col("descripcion").alias("value"),
            F.lit(stage).alias("etapa"),
            "fecha",
        )
        for df, stage in sources
    ]
    groups = where_equal(reduce(DataFrame.unionByName, tagged), etapa=etapa)
    return groups.distinct().orderBy(F.col("fecha").asc_nulls_last(), "label")


def group_block_quality(
    t: Tables, grupo: str | None = None, categoria: str | None = None, etapa: str | None = None
) -> DataFrame:
    """Quality counters of the blocks of a group.

    Group and category select the rows. The stage only goes into the link, so blocks of all
    stages are listed; left out, each row links to its own stage.
    """
    stage = F.col("etapa2") if etapa is None else F.lit(etapa)
    target = ("/", stage, "-detalle-bloque?bloque=", F.col("bloque"), "#", F.col("categoria"))
    return where_equal(t.calidad_aplicaciones, grupo=grupo, categoria=categoria).select(
        *free(grupo=grupo, categoria=categoria),
        link(F.col("bloque"), *target).alias("bloque"),
        F.col("fecha_siembra").alias("fecha de siembra"),
        F.col("finduccion").alias("fecha de inducción"),
        F.col("aplicaciones_pendientes").alias("# de aplicaciones pendientes"),
        F.col("num_aplicaciones_realizadas").alias("# de aplicaciones realizadas"),
        F.col("aplicaciones_con_retraso").alias("# de aplicaciones realizadas tardías"),
        F.col("aplicaciones_muy_proximas").alias("# de aplicaciones realizadas adelantadas"),
    )


def group_table(
    t: Tables, grupo: str | None = None, categoria: str | None = None, etapa: str | None = None
) -> DataFrame:
    """The block counters as their page shows them, all text and blank where missing. Keys of a
    wider report stay null."""
    return fill_blank(
        group_block_quality(t, grupo, categoria, etapa), *free(grupo=grupo, categoria=categoria)
    )


def group_weights(t: Tables, grupo_siembra: str | None = None) -> DataFrame:
    """Mean plant weight per block and day of a planting group, to two digits.

    The key of a block here is cycle and description, as in the reference. Samples are summed per
    block and day before the group is looked up. Without a group, `grupo_siembra` is a key.
    """
    blocks = where_equal(t.blocks_desarrollo, grupo_siembra=grupo_siembra).select(
        "grupo_siembra", block_key(F.col("desarrollo"), F.col("descripcion")).alias("_llave")
    )
    if grupo_siembra is None:
        of_group = daily_weights(t).join(blocks.distinct(), F.col("llave") == F.col("_llave"))
    else:
        of_group = daily_weights(t, blocks.select(F.col("_llave").alias("llave")))
    mean = F.round(F.try_divide("suma", F.col("n").cast("decimal(20,0)")), 2)
    return of_group.select(
        *free(grupo_siembra=grupo_siembra), "llave", "fecha", mean.alias("promedio")
    )


def group_applications(
    t: Tables, grupo: str | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """Treatment orders of a group with the treated blocks, one row each with its number of times,
    by date when one group, stage and category is asked for."""
    keys = free(grupo=grupo, etapa2=etapa2, categoria=categoria)
    rows = where_equal(t.aplicaciones, grupo=grupo, etapa2=etapa2, categoria=categoria).select(
        *keys,
        F.col("codigo_cedula").alias("codigo cédula"),
        F.col("fecha").alias("fecha aplicación"),
        F.col("descripcion_formula").alias("formula"),
        "blocknumber",
    )
    order = ["codigo cédula", "fecha aplicación", "formula"]
    listed = entries(rows, [*keys, *order], "blocknumber", "bloque")
    if keys:
        return listed
    return listed.orderBy(F.col("fecha aplicación").asc_nulls_last(), *order, "bloque")


def group_application_table(
    t: Tables, grupo: str | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """The treatment orders as their page shows them, with the date as text."""
    rows = group_applications(t, grupo, etapa2, categoria)
    return rows.withColumn("fecha aplicación", spanish_date(F.col("fecha aplicación")))
