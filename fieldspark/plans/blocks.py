"""One block, or all of them: treatments, milestones and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.functions.dates import spanish_date
from fieldspark.functions.text import block_key, labelled, link, underscored
from fieldspark.operators.frames import free, where_equal
from fieldspark.sources.tables import Tables

# Milestones shown for a stage.
MILESTONES = {
    "preforza": (("siembra", "fecha_siembra"), ("inducción", "finduccion")),
    "postforza": (("inducción", "finduccion"), ("cosecha", "mediana_fecha_cosecha")),
}

# The group column of a stage.
STAGE_GROUP = {
    "preforza": "grupo_siembra",
    "postforza": "grupo_forza",
    "semillero": "grupo_semillero",
}


def block_list(t: Tables) -> DataFrame:
    """Blocks with display label and key, oldest planting first."""
    rows = t.blocks_desarrollo.select(
        block_key(F.col("desarrollo"), F.col("descripcion")).alias("label"),
        block_key(F.col("desarrollo"), F.col("blocknumber")).alias("value"),
        "fecha_siembra",
    )
    ordered = rows.orderBy(F.col("fecha_siembra").asc_nulls_last(), "value", "label")
    return ordered.select("label", "value")


def _by_date(df: DataFrame, bloque: str | None) -> DataFrame:
    """Sorted by date for a single block; a listing of all blocks is left as it is stored."""
    if bloque is None:
        return df
    return df.orderBy(F.col("fecha").asc_nulls_last(), *[c for c in df.columns if c != "fecha"])


def block_applications(
    t: Tables, bloque: str | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """Treatments of a block with their timing class and score."""
    calidad = F.col("calidad")
    formula_link = link(
        F.col("codigo_formula"), "/detalle-formula?codigo=", underscored(F.col("codigo_formula"))
    )
    rows = where_equal(t.aplicaciones, bloque=bloque, etapa2=etapa2, categoria=categoria).select(
        *free(bloque=bloque, etapa2=etapa2, categoria=categoria),
        "blocknumber",
        F.col("codigo_cedula").alias("codigo cédula"),
        "fecha",
        formula_link.alias("código fórmula"),
        F.col("descripcion_formula").alias("formula"),
        "motivo",
        F.col("dias_diferencia").alias("dias desde la aplicación anterior"),
        rules.timing_lenient(calidad).alias("color"),
        rules.timing_score(calidad).alias("calificacion"),
    )
    return _by_date(rows, bloque)


def block_applications_all(
    t: Tables, bloque: str | None = None, etapa2: str | None = None
) -> DataFrame:
    """Treatments of a block in all categories, unrated and without repeats."""
    rows = where_equal(t.aplicaciones, bloque=bloque, etapa2=etapa2).select(
        *free(bloque=bloque, etapa2=etapa2),
        "blocknumber",
        F.col("codigo_cedula").alias("codigo cédula"),
        "fecha",
        F.col("descripcion_formula").alias("formula"),
        "motivo",
        F.lit(rules.UNRATED).alias("color"),
        F.lit(0).alias("calificacion"),
    )
    return _by_date(rows.distinct(), bloque)


def block_pending(
    t: Tables, bloque: str | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """Pending treatments of a block."""
    rows = where_equal(
        t.aplicaciones_pendientes, bloque=bloque, etapa2=etapa2, categoria=categoria
    ).select(
        "bloque",
        "fecha",
        "categoria",
        "etapa",
        "etapa2",
        F.lit(-1).alias("calificacion"),
        F.lit(rules.PENDING).alias("color"),
        F.lit(rules.PENDING).alias("formula"),
    )
    return _by_date(rows, bloque)


def block_table(
    t: Tables, bloque: str | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """Treatments as the block page lists them, with the date as text. The category `todas`
    lists all categories, unrated."""
    if categoria == "todas":
        rows = block_applications_all(t, bloque, etapa2)
    else:
        rows = block_applications(t, bloque, etapa2, categoria)
    shown = rows.withColumn("fecha ejecución", spanish_date(F.col("fecha")))
    return shown.drop("blocknumber", "fecha", "color", "calificacion")


def block_timeline(
    t: Tables, bloque: str | None = None, etapa2: str | None = None, categoria: str | None = None
) -> DataFrame:
    """Treatments done and pending in one frame; columns only one of them has are null in the
    other. Pending treatments are listed also for blocks without a treatment done. The category
    `todas` lists the treatments of all categories, unrated, and what is pending in any."""
    if categoria == "todas":
        done, categoria = block_applications_all(t, bloque, etapa2), None
    else:
        done = block_applications(t, bloque, etapa2, categoria)
    pending = block_pending(t, bloque, etapa2, categoria)
    both = done.unionByName(pending, allowMissingColumns=True)
    return both.withColumn("fecha_str", spanish_date(F.col("fecha")))


def block_milestones(
    t: Tables, bloque: str | None = None, etapa2: str | None = None
) -> DataFrame:
    """Dated milestones of a block within a stage; those not reached are left out."""
    marks = [
        F.struct(F.lit(stage).alias("etapa2"), F.lit(name).alias("hito"), F.col(column).alias("fecha"))
        for stage, milestones in MILESTONES.items()
        if etapa2 in (None, stage)
        for name, column in milestones
    ]
    rows = where_equal(t.blocks_desarrollo, bloque=bloque)
    # Stages without milestones keep the schema and give no rows.
    nothing = F.expr("cast(array() as array<struct<etapa2:string,hito:string,fecha:date>>)")
    text = labelled(F.col("hito"), F.concat(F.lit(" "), spanish_date(F.col("fecha"))))
    return (
        rows.select("bloque", F.inline(F.array(*marks) if marks else nothing))
        .where(F.col("fecha").isNotNull())
        .withColumn("texto", text)
    )


def stage_group(etapa2: Column) -> Column:
    """The group of a block in a stage; `desconocido` for other stages."""
    group = F
    for stage, column in STAGE_GROUP.items():
        group = group.when(etapa2 == stage, F.col(column))
    return group.otherwise(rules.UNKNOWN_GROUP)


def block_group_by_stage(
    t: Tables, etapa2: str | None = None, bloque: str | None = None
) -> DataFrame:
    """The group a block belongs to in a stage; without a stage, in each of them."""
    rows = where_equal(t.blocks_desarrollo, bloque=bloque)
    if etapa2 is None:
        rows = rows.withColumn("etapa2", F.explode(F.array(*map(F.lit, STAGE_GROUP))))
    else:
        rows = rows.withColumn("etapa2", F.lit(etapa2))
    return rows.select("bloque", "etapa2", stage_group(F.col("etapa2")).alias("grupo"))
