"""Lots and formulas: block status of a lot, inputs of a formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.text import link
from fieldspark.operators.frames import fill_blank, free, where_equal
from fieldspark.sources.tables import Tables


def lot_list(t: Tables) -> DataFrame:
    return t.lotes_detalle.select("label", "value").orderBy(
        F.col("label").asc_nulls_last(), F.col("value").asc_nulls_last()
    )


def lot_block_status(t: Tables, lote: str | None = None) -> DataFrame:
    """Milestones of the blocks of a lot, with links to their groups and stages."""

    def group(column: str, page: str, parameter: str) -> Column:
        return link(F.col(column), f"/{page}-detalle-grupo?{parameter}=", F.col(column))

    def stage(column: str, page: str, cycle: str) -> Column:
        return link(F.col(column), f"/{page}-detalle-bloque?bloque={cycle}", F.col("bloque"))

    return where_equal(t.historia_bloques, lote=lote).select(
        *free(lote=lote),
        "bloque",
        group("grupo_siembra", "preforza", "gs").alias("grupo de siembra"),
        group("grupo_forza", "postforza", "gf").alias("grupo de forza"),
        group("grupo_semillero", "semillero", "gse").alias("grupo semillero"),
        group("grupo_2da_cosecha", "preforza", "gs").alias("grupo inicio 2da"),
        group("grupo_forza2", "postforza", "gf").alias("grupo forza 2da"),
        stage("siembra", "preforza", "PC").alias("siembra"),
        stage("finduccion", "postforza", "PC").alias("induccion pc"),
        F.col("fecha_cosecha_pc").alias("cosecha 1ra"),
        "poda",
        stage("deshija", "preforza", "SC").alias("deshija"),
        stage("finduccion2", "postforza", "SC").alias("induccion 2da"),
        F.col("fecha_cosecha_sc").alias("cosecha 2da"),
        F.col("semillerosegunda").alias("semillero 2da"),
        "barrido",
    )


def lot_table(t: Tables, lote: str | None = None) -> DataFrame:
    """The milestones as their page shows them, all text and blank where missing."""
    return fill_blank(lot_block_status(t, lote))


def formula_list(t: Tables) -> DataFrame:
    code = F.col("codigo")
    return t.formulas.select(code.alias("label"), code.alias("value")).orderBy(
        F.col("label").asc_nulls_last()
    )


def formula_inputs(t: Tables, codigo: str | None = None) -> DataFrame:
    """Inputs of a formula with their names; codes are matched without surrounding spaces."""
    inputs = t.agroinsumos.select(F.trim("insumo").alias("_insumo"), "nombre_insumo")
    rows = where_equal(t.formulas_det, codigo=codigo)
    return rows.join(inputs, F.trim("insumo") == F.col("_insumo"), "left").select(
        F.col("codigo").alias("codigo_formula"),
        "insumo",
        "nombre_insumo",
        "categoria",
        "cantha",
        "descripcion",
    )
