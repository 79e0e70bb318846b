"""Alerts: blocks whose last nutrition treatment is some time ago, and blocks never treated."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.dates import days_since, spanish_date
from fieldspark.functions.rules import in_list
from fieldspark.functions.text import labelled, lot_of_block
from fieldspark.operators.frames import first_per_key
from fieldspark.operators.joins import in_keys, not_in
from fieldspark.operators.lists import cell_text, entries
from fieldspark.sources.tables import Tables

# Stages of the three alert pages, the category they watch, the age limit of the
# pages, the line between the groups of one cell, and nursery states of a planting.
PREFORZA = ("Post Siembra", "Post Deshija")
POSTFORZA = ("Post Forza",)
SEMILLERO = ("Post Poda",)
CATEGORY = "nutricion"
MAX_DAYS = 100
GROUP_LINE = "\n---------------------\n"
NURSERY_STATES = ("3", "7")


def _latest() -> list[Column]:
    """The latest date first and, as in PostgreSQL, a missing date before all; ties by text."""
    ties = ("codigo_formula", "grupo", "descripcion_formula")
    return [F.col("fecha").desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in ties]]


def _nutrition(t: Tables, as_of: dt.date, etapas: Sequence[str], max_days: int | None) -> DataFrame:
    """Treatments an alert looks at.

    With an age limit only recent treatments are read: a block whose last treatment is recent has
    it among them, and a block without recent ones is over the limit. Undated treatments stay,
    because one of them hides its block.
    """
    recent = None
    if max_days is not None:
        recent = [(as_of - dt.timedelta(days=max_days), None)]
    rows = t.dated("aplicaciones", recent, keep_null=True)
    return rows.where(
        in_list(F.col("etapa"), etapas)
        & (F.col("categoria") == CATEGORY)
        & F.col("grupo").isNotNull()
        & F.col("bloque").isNotNull()
    )


def _alert(last: DataFrame, as_of: dt.date, max_days: int | None) -> DataFrame:
    days = days_since(F.col("fecha"), as_of)
    rows = last.select(
        "bloque",
        "grupo",
        "fecha",
        "descripcion_formula",
        days.alias("dias_desde_ultima_aplicacion"),
    )
    if max_days is None:
        return rows
    return rows.where(F.col("dias_desde_ultima_aplicacion") <= max_days)


def alert_preforza(
    t: Tables,
    as_of: dt.date,
    etapas: Sequence[str] = PREFORZA,
    max_days: int | None = None,
) -> DataFrame:
    """Last treatment of each block not yet induced.

    The state of the crop depends on the block only, so the last treatment per block is taken
    first and the blocks table meets one row per block.
    """
    last = first_per_key(_nutrition(t, as_of, etapas, max_days), ["bloque"], _latest())
    growing = t.blocks_desarrollo.where(F.col("finduccion").isNull())
    return _alert(in_keys(last, "bloque", growing, "bloque"), as_of, max_days)


def alert_postforza(
    t: Tables,
    as_of: dt.date,
    etapas: Sequence[str] = POSTFORZA,
    max_days: int | None = None,
) -> DataFrame:
    """Last treatment of each block not in the harvest summary.

    The second-crop stage `Post 2da Forza` is not among the default stages, as in the reference.
    """
    last = first_per_key(_nutrition(t, as_of, etapas, max_days), ["bloque"], _latest())
    return _alert(not_in(last, "bloque", t.cosecha_resumen, "bloque"), as_of, max_days)


def alert_semillero(
    t: Tables,
    as_of: dt.date,
    etapas: Sequence[str] = SEMILLERO,
    max_days: int | None = None,
) -> DataFrame:
    """Last treatment of each block whose field is in a nursery state."""
    rows = _nutrition(t, as_of, etapas, max_days)
    last = first_per_key(rows, ["bloque", "blocknumber"], _latest())
    nursery = t.siembra.where(in_list(F.col("estado"), NURSERY_STATES))
    in_nursery = in_keys(last, "blocknumber", nursery, "blocknumber")
    return _alert(first_per_key(in_nursery, ["bloque"], _latest()), as_of, max_days)


def alert_new_blocks(t: Tables, as_of: dt.date) -> DataFrame:
    """Blocks not yet induced that have no treatment on record."""
    growing = t.blocks_desarrollo.where(F.col("finduccion").isNull())
    days = days_since(F.col("fecha_siembra"), as_of)
    return not_in(growing, "bloque", t.aplicaciones, "bloque").select(
        "bloque", "fecha_siembra", days.alias("dias_sin_aplicacion")
    )


def _cell(rows: DataFrame, by_lot: bool) -> tuple[DataFrame, list[str]]:
    cell = ["fecha", "descripcion_formula", "dias_desde_ultima_aplicacion"]
    if by_lot:
        return rows.withColumn("lote", lot_of_block(F.col("bloque"))), [*cell[:2], "lote", cell[2]]
    return rows, cell


def alert_list(rows: DataFrame, by_lot: bool) -> DataFrame:
    """Alert rows as the pages list them: the blocks of each date, formula, days, group and, with
    `by_lot`, lot; longest without treatment first."""
    rows, cell = _cell(rows, by_lot)
    listed = entries(rows, [*cell, "grupo"], "bloque", "bloque")
    ordered = listed.orderBy(F.col(cell[-1]).desc_nulls_last(), *cell[1:-1], "fecha", "grupo", "bloque")
    return ordered.withColumn("fecha", spanish_date(F.col("fecha")))


def alert_text(rows: DataFrame, by_lot: bool) -> DataFrame:
    """The cells of one alert page: `group:block, block` for each group, one row per date, formula,
    days and, with `by_lot`, lot."""
    rows, cell = _cell(rows, by_lot)
    listed = entries(rows, [*cell, "grupo"], "bloque", "bloque")
    blocks = cell_text(listed, [*cell, "grupo"], "bloque", ", ", "bloques").withColumn(
        "grupo_bloques", labelled(F.col("grupo"), F.col("bloques"))
    )
    text = cell_text(blocks, cell, "grupo_bloques", GROUP_LINE, "bloques_pendientes")
    ordered = text.orderBy(F.col(cell[-1]).desc_nulls_last(), *cell[1:-1], "bloques_pendientes")
    return ordered.withColumn("fecha", spanish_date(F.col("fecha")))


def alert_preforza_list(t: Tables, as_of: dt.date, max_days: int = MAX_DAYS) -> DataFrame:
    return alert_list(alert_preforza(t, as_of, max_days=max_days), by_lot=True)


def alert_semillero_list(t: Tables, as_of: dt.date, max_days: int = MAX_DAYS) -> DataFrame:
    return alert_list(alert_semillero(t, as_of, max_days=max_days), by_lot=True)


def alert_postforza_list(t: Tables, as_of: dt.date, max_days: int = MAX_DAYS) -> DataFrame:
    return alert_list(alert_postforza(t, as_of, max_days=max_days), by_lot=False)


def alert_new_blocks_list(t: Tables, as_of: dt.date) -> DataFrame:
    """Untreated blocks by planting date, longest without treatment first."""
    cell = ["fecha_siembra", "dias_sin_aplicacion"]
    listed = entries(alert_new_blocks(t, as_of), cell, "bloque", "bloque")
    ordered = listed.orderBy(F.col("dias_sin_aplicacion").desc_nulls_last(), "bloque")
    return ordered.withColumn("fecha_siembra", spanish_date(F.col("fecha_siembra")))


def alert_new_blocks_text(t: Tables, as_of: dt.date) -> DataFrame:
    """The cells of the page of untreated blocks."""
    cell = ["fecha_siembra", "dias_sin_aplicacion"]
    listed = entries(alert_new_blocks(t, as_of), cell, "bloque", "bloque")
    text = cell_text(listed, cell, "bloque", ", ", "bloque")
    ordered = text.orderBy(F.col("dias_sin_aplicacion").desc_nulls_last(), "bloque")
    return ordered.withColumn("fecha_siembra", spanish_date(F.col("fecha_siembra")))
