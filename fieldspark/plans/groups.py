"""Comparison of planting groups: treatment quality by group and by month.

Stage (`etapa2`) and category (`categoria`) select one page of the reference reports. Left out,
they stay in the result as leading key columns and the report covers all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.functions.dates import month_start, year_ranges
from fieldspark.functions.text import link
from fieldspark.operators.frames import first_per_key, free, where_equal
from fieldspark.sources.tables import Tables

GROUP = "nombre grupo"
GROUP_START = "fecha inicio grupo"
MAX_COUNT = "Número máximo de aplicaciones"


def group_dates(t: Tables) -> DataFrame:
    """Start dates of all groups, without repeats: every date of a planting group, the latest
    date of the other kinds."""

    def latest(df: DataFrame) -> DataFrame:
        return df.groupBy("descripcion").agg(F.max("fecha").alias("fecha"))

    others = (t.grupossemillero, t.gruposforza2, t.gruposforza, t.grupos2dacosecha)
    return reduce(DataFrame.unionByName, [latest(df) for df in others], t.grupossiembra).distinct()


def group_quality(t: Tables, etapa2: str | None = None, categoria: str | None = None) -> DataFrame:
    """Per group: blocks, blocks still to be forced and the worst counters of any block.

    A group with several start dates gives one row per date, as the plain left join does.
    """
    counted = (
        where_equal(t.calidad_aplicaciones, etapa2=etapa2, categoria=categoria)
        .groupBy("etapa2", "categoria", F.col("grupo").alias(GROUP))
        .agg(
            F.count("bloque").alias("numero_bloques"),
            (F.count("bloque") - F.count("finduccion")).alias("bloques_por_forzar"),
            F.max("aplicaciones_con_retraso").alias("max_aplicaciones_tardias"),
            F.max("aplicaciones_muy_proximas").alias("max_aplicaciones_adelantadas"),
            F.max("aplicaciones_pendientes").alias("max_aplicaciones_pendientes"),
        )
    )
    name = F.col(GROUP)
    target = ("/", F.col("etapa2"), "-detalle-grupo?grupo=", name, "#", F.col("categoria"))
    keys = free(etapa2=etapa2, categoria=categoria)
    return (
        counted.join(group_dates(t), name == F.col("descripcion"), "left")
        .select(
            *keys,
            link(name, *target).alias("grupo"),
            GROUP,
            F.col("fecha").alias(GROUP_START),
            "numero_bloques",
            "bloques_por_forzar",
            "max_aplicaciones_tardias",
            "max_aplicaciones_adelantadas",
            "max_aplicaciones_pendientes",
        )
        .orderBy(F.col(GROUP_START).asc_nulls_last(), GROUP, *keys)
    )


def groups_started_in_year(
    t: Tables, anio: int | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """`group_quality` rows of groups that started in a year (`anio`, a key when left out)."""
    started = group_quality(t, etapa2, categoria).withColumn("anio", F.year(GROUP_START))
    if anio is None:
        return started.where(F.col("anio").isNotNull())
    return started.where(F.col("anio") == anio).drop("anio")


def group_quality_long(
    t: Tables, anio: int | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """The three worst counters of each group, one row per counter."""
    wide = groups_started_in_year(t, anio, etapa2, categoria).withColumnsRenamed(
        {
            "max_aplicaciones_tardias": rules.LATE,
            "max_aplicaciones_adelantadas": rules.EARLY,
            "max_aplicaciones_pendientes": rules.PENDING,
        }
    )
    ids = [*free(anio=anio, etapa2=etapa2, categoria=categoria), GROUP]
    return wide.unpivot(ids, [rules.LATE, rules.EARLY, rules.PENDING], "calidad", MAX_COUNT)


def group_quality_totals(
    t: Tables, anio: int | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """The long counters summed per group and class, the heights of the group chart."""
    keys = [*free(anio=anio, etapa2=etapa2, categoria=categoria), GROUP, "calidad"]
    long = group_quality_long(t, anio, etapa2, categoria)
    return long.groupBy(*keys).agg(F.sum(MAX_COUNT).alias("total"))


def tolerance_lookup(t: Tables, etapa2: str, categoria: str) -> DataFrame:
    """Target days between treatments and tolerances of a stage and category: one row or none."""
    days = ["dias_entre_aplicaciones", "tolerancia_rango_inferior", "tolerancia_rango_superior"]
    rows = where_equal(t.rangos_calidad_aplicaciones, etapa2=etapa2, categoria=categoria)
    return rows.select(*days).orderBy(*days).limit(1)


def tolerances_in_use(t: Tables) -> DataFrame:
    """The tolerance lookup for every stage and category that has treatments on record."""
    days = ["dias_entre_aplicaciones", "tolerancia_rango_inferior", "tolerancia_rango_superior"]
    keys = ["etapa2", "categoria"]
    used = t.calidad_aplicaciones.select(*keys).distinct()
    first = first_per_key(t.rangos_calidad_aplicaciones, keys, [F.col(d) for d in days])
    return used.join(first.select(*keys, *days), keys, "left")


def _month_rows(
    t: Tables, name: str, calidad: Column, etapa2: str | None, categoria: str | None, anio: int | None
) -> DataFrame:
    """Treatments of a table with month and class, before blocks are looked up."""
    rows = where_equal(t.dated(name, year_ranges(anio)), etapa2=etapa2, categoria=categoria)
    return rows.select(
        *free(etapa2=etapa2, categoria=categoria),
        "blocknumber",
        "grupo",
        month_start(F.col("fecha")).alias("mes"),
        calidad.alias("calidad"),
    )


def _with_blocks(t: Tables, rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(t.blocks, F.col("blocknumber") == F.col("codigo"), "left").select(
        *keys,
        "grupo",
        (F.col("area") / 10000).alias("area_aplicacion"),
        "lote",
        "mes",
        F.lit(1).alias("conteo"),
        "calidad",
    )


def monthly_quality_rows(
    t: Tables, etapa2: str | None = None, categoria: str | None = None, anio: int | None = None
) -> DataFrame:
    """Treatments done, with area, lot, month and timing class."""
    rows = _month_rows(
        t, "aplicaciones", rules.timing_strict(F.col("calidad")), etapa2, categoria, anio
    )
    return _with_blocks(t, rows, free(etapa2=etapa2, categoria=categoria))


def monthly_pending_rows(
    t: Tables, etapa2: str | None = None, categoria: str | None = None, anio: int | None = None
) -> DataFrame:
    """Pending treatments in the same form."""
    rows = _month_rows(
        t, "aplicaciones_pendientes", F.lit(rules.PENDING), etapa2, categoria, anio
    )
    return _with_blocks(t, rows, free(etapa2=etapa2, categoria=categoria))


def _month_treatments(
    t: Tables, etapa2: str | None, categoria: str | None, anio: int | None
) -> DataFrame:
    """Done and pending treatments with month and class."""
    done = _month_rows(
        t, "aplicaciones", rules.timing_strict(F.col("calidad")), etapa2, categoria, anio
    )
    pending = _month_rows(
        t, "aplicaciones_pendientes", F.lit(rules.PENDING), etapa2, categoria, anio
    )
    return done.unionByName(pending).dropna(subset=["mes", "calidad"])


def _monthly_counts(
    t: Tables, keys: list[str], etapa2: str | None, categoria: str | None, anio: int | None
) -> DataFrame:
    """Treatments of groups by `keys`. In the row-level join a block listed more than once counts that
    often, so treatments are counted per block first, in one pass over each table, and the
    counts meet the number of listings."""
    rows = _month_treatments(t, etapa2, categoria, anio).where(F.col("grupo").isNotNull())
    cells = rows.groupBy(*keys, "blocknumber").agg(F.count(F.lit(1)).alias("n"))
    listings = t.blocks.groupBy("codigo").agg(F.count(F.lit(1)).alias("veces"))
    listed = cells.join(listings, F.col("blocknumber") == F.col("codigo"), "left")
    conteo = F.sum(F.col("n") * F.coalesce("veces", F.lit(1)))
    return listed.groupBy(*keys).agg(conteo.alias("conteo"))


def monthly_quality_by_group(
    t: Tables, etapa2: str | None = None, categoria: str | None = None, anio: int | None = None
) -> DataFrame:
    """Treatments per month, group and class; rows without a month, group or class are dropped.

    Pending treatments are counted also where no treatment was done.
    """
    keys = [*free(etapa2=etapa2, categoria=categoria), "mes", "grupo", "calidad"]
    return _monthly_counts(t, keys, etapa2, categoria, anio)


def monthly_quality_area_by_lot(
    t: Tables, etapa2: str | None = None, categoria: str | None = None, anio: int | None = None
) -> DataFrame:
    """Treated hectares per month, lot and class; rows without one of these are dropped, and
    treatments without an area add nothing.

    The treatments are counted per block before they meet the blocks table: a busy block joins as
    a few counted rows.
    """
    months = [*free(etapa2=etapa2, categoria=categoria), "mes", "calidad"]
    counted = (
        _month_treatments(t, etapa2, categoria, anio)
        .groupBy(*months, "blocknumber")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    areas = (
        t.blocks.where(F.col("lote").isNotNull())
        .groupBy("codigo", "lote")
        .agg(F.sum("area").alias("area"))
    )
    area = F.sum(F.col("n") * F.col("area")) / 10000
    return (
        counted.join(areas, F.col("blocknumber") == F.col("codigo"))
        .groupBy(*months, "lote")
        .agg(F.coalesce(area, F.lit(0.0)).alias("area_aplicacion"))
    )


def monthly_quality_totals(
    t: Tables, etapa2: str | None = None, categoria: str | None = None, anio: int | None = None
) -> DataFrame:
    """Treatments per month and class, the heights of the monthly chart. Groups only decide which
    treatments count, so they are no key on the way."""
    keys = [*free(etapa2=etapa2, categoria=categoria), "mes", "calidad"]
    return _monthly_counts(t, keys, etapa2, categoria, anio)


def monthly_quality_share(
    t: Tables, etapa2: str | None = None, categoria: str | None = None, anio: int | None = None
) -> DataFrame:
    """Percentage of each class among the treatments of its month."""
    month = W.partitionBy(*free(etapa2=etapa2, categoria=categoria), "mes")
    share = 100 * F.col("conteo") / F.sum("conteo").over(month)
    return monthly_quality_totals(t, etapa2, categoria, anio).withColumn("porcentaje", share)
