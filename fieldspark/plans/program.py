"""Weekly treatment programme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.functions.dates import spanish_date, week_ranges
from fieldspark.functions.text import labelled
from fieldspark.operators.frames import dealt, merged
from fieldspark.operators.lists import cell_text, entries, totals
from fieldspark.sources.tables import Tables

# Fixed value: text between the groups of one cell.
GROUP_GAP = " \n \n  "

ORDER = ["fecha", "codformula", "formula"]


def current_groups(t: Tables) -> DataFrame:
    """The group each planted block belongs to now."""
    planted = t.historia_bloques.where(F.col("grupo_siembra").isNotNull())
    return planted.select("bloque", rules.current_group().alias("grupo"))


def _planned(t: Tables, anio: int | None, semana: int | None) -> DataFrame:
    """Planned blocks and area by date, formula and current group."""
    plan = t.dated("programacionaplicaciones", week_ranges(anio, semana))
    rows = plan.count()
    # Counted per block before the join, so that a busy block joins as one row per order.
    planned = (
        dealt(plan.select(*ORDER, "block", "area"), *ORDER, "block", rows=rows)
        .distinct()
        .groupBy(*ORDER, "block")
        .agg(
            F.count(F.lit(1)).alias("veces"),
            F.sum(F.col("area").cast("decimal(18,4)")).alias("area"),
        )
    )
    by_block = dealt(planned, "block", rows=rows)
    groups = merged(current_groups(t), t.historia_bloques.count())
    return by_block.join(groups, F.col("block") == F.col("bloque"), "left")


def _sorted(rows: DataFrame, semana: int | None, *columns: str) -> DataFrame:
    if semana is None:
        return rows
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def weekly_program_rows(
    t: Tables, anio: int | None = None, semana: int | None = None
) -> DataFrame:
    """Planned blocks by date, formula and current group, with the times each is planned.

    `anio` is the calendar year and `semana` the ISO week number; left out, all weeks are listed.
    """
    rows = entries(_planned(t, anio, semana), [*ORDER, "grupo"], "block", "bloque", times="veces")
    return _sorted(rows, semana, "fecha", "formula", "codformula", "grupo", "bloque")


def weekly_program_area(
    t: Tables, anio: int | None = None, semana: int | None = None
) -> DataFrame:
    """Total area, to two digits, and entries of each date, formula and current group."""
    rows = totals(_planned(t, anio, semana), [*ORDER, "grupo"], ["area"], "veces")
    rows = rows.withColumn("area", F.round("area", 2))
    return _sorted(rows, semana, "fecha", "formula", "codformula", "grupo")


def weekly_program(t: Tables, anio: int | None = None, semana: int | None = None) -> DataFrame:
    """The programme as its page lists it: the blocks of each date, formula and group, the date as
    text. Sorted by date, not by the text of the date."""
    rows = _planned(t, anio, semana).withColumn(
        "grupo", F.coalesce("grupo", F.lit(rules.CHECK_GROUP))
    )
    listed = entries(rows, [*ORDER, "grupo"], "block", "bloque", times="veces")
    ordered = _sorted(listed, semana, *ORDER, "grupo", "bloque")
    return ordered.withColumn("fecha", spanish_date(F.col("fecha")))


def weekly_program_text(t: Tables, anio: int, semana: int) -> DataFrame:
    """The cells of one week's page: `group:block, block` for each group, one row per date and
    formula."""
    rows = _planned(t, anio, semana).withColumn(
        "grupo", F.coalesce("grupo", F.lit(rules.CHECK_GROUP))
    )
    listed = entries(rows, [*ORDER, "grupo"], "block", "bloque", times="veces")
    blocks = cell_text(listed, [*ORDER, "grupo"], "bloque", ", ", "bloques").withColumn(
        "grupo_bloques", labelled(F.col("grupo"), F.col("bloques"))
    )
    text = cell_text(blocks, ORDER, "grupo_bloques", GROUP_GAP, "bloques programados")
    return _sorted(text, semana, *ORDER).withColumn("fecha", spanish_date(F.col("fecha")))
