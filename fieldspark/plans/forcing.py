"""Blocks ready for flowering induction, and what later induction would mean."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.functions.dates import months_since
from fieldspark.functions.rules import in_list, ratio
from fieldspark.functions.text import block_key
from fieldspark.operators.frames import first_per_key, merged, round_numbers
from fieldspark.plans.weights import last_weight_before_induction, latest_weight
from fieldspark.sources.tables import Tables

# Days from induction to harvest; days and grams added by each scenario step; first
# planting date considered; limits of the forcing rule.
DAYS_TO_HARVEST = 140
STEP_DAYS = (0, 7, 15, 21, 29)
STEP_GRAMS = 200
PLANTED_SINCE = dt.date(2018, 1, 1)
MONTHS_FIRST_CROP = 10
MONTHS_SECOND_CROP = 3
GRAMS_FIRST_CROP = 2500


def _ready(t: Tables, as_of: dt.date, planted_since: dt.date) -> DataFrame:
    """Blocks not yet induced that are old or heavy enough, one row each, with age and last sample.

    Blocks and samples are both reduced to one row per block before they are joined.
    """
    growing = t.blocks_desarrollo.where(
        F.col("finduccion").isNull()
        & ~F.col("bloque").endswith("J")
        & (F.col("fecha_siembra") >= F.lit(planted_since))
    ).select("bloque", "blocknumber", "desarrollo", "grupo_siembra", "fecha_siembra")
    order = [F.col(c) for c in ("fecha_siembra", "blocknumber", "desarrollo", "grupo_siembra")]
    blocks = first_per_key(growing, ["bloque"], order)
    rows = t.blocks_desarrollo.count()
    weight = latest_weight(t, merged(blocks.select(F.col("bloque").alias("llave")), rows))
    sampled = blocks.join(merged(weight, rows), F.col("bloque") == F.col("llave"), "left").withColumn(
        "edad", months_since(F.col("fecha_siembra"), as_of)
    )
    first_crop = (F.col("desarrollo") == "PC") & (
        (F.col("edad") > MONTHS_FIRST_CROP) | (F.col("peso_planta") > GRAMS_FIRST_CROP)
    )
    second_crop = (F.col("desarrollo") == "SC") & (F.col("edad") > MONTHS_SECOND_CROP)
    return sampled.where(first_crop | second_crop)


def forcing_candidates(
    t: Tables, as_of: dt.date, planted_since: dt.date = PLANTED_SINCE
) -> DataFrame:
    """Blocks ready for induction with areas and last sample, oldest first."""
    detail = t.blocks_detalle.select("blocknumber", "area", "drenajes", "poblacion", "rango_semilla")
    detail = merged(detail, t.blocks_detalle.count())
    hectares = rules.net_hectares(F.col("area"), F.col("drenajes"))
    return (
        _ready(t, as_of, planted_since)
        .join(detail, "blocknumber", "left")
        .select(
            "bloque",
            "desarrollo",
            F.col("grupo_siembra").alias("grupo siembra"),
            F.col("fecha_siembra").alias("fecha siembra"),
            "poblacion",
            hectares.alias("area neta (ha)"),
            ratio(F.col("poblacion"), hectares).alias("densidad"),
            F.col("edad").alias("edad actual meses"),
            F.col("fecha_muestreo").alias("fecha ultimo muestreo"),
            F.col("peso_planta").alias("peso promedio ultimo muestreo"),
            F.col("rango_semilla").alias("rango semilla"),
        )
        .orderBy(F.col("edad actual meses").desc_nulls_first(), "bloque")
    )


def forcing_table(t: Tables, as_of: dt.date, planted_since: dt.date = PLANTED_SINCE) -> DataFrame:
    """The candidates as their page shows them, numbers to two digits."""
    return round_numbers(forcing_candidates(t, as_of, planted_since))


def _base(
    t: Tables,
    rows: DataFrame,
    *carried: str,
    few: bool = False,
    weights: DataFrame | None = None,
) -> DataFrame:
    """The model base of some rows of `blocks_desarrollo`; `carried` columns are kept in front.

    `few` says that the rows are few enough to limit the samples before they are summed.
    """
    key = block_key(F.col("desarrollo"), F.col("blocknumber")).alias("llave")
    blocks = rows.select(
        *carried, "blocknumber", "desarrollo", key, "fecha_siembra", "grupo_forza", "finduccion"
    )
    first_crop = t.blocks_desarrollo.where(F.col("desarrollo") == "PC").select(
        "blocknumber",
        F.lit("SC").alias("desarrollo"),
        F.col("kilos_cosechados").alias("kilos_pc"),
        F.col("frutas").alias("frutas_pc"),
        F.col("fecha_siembra").alias("fecha_siembra_pc"),
    )
    if weights is None:
        weights = last_weight_before_induction(t, blocks.select("llave") if few else None)
    harvested = t.cosecha_resumen.select(key, "kilos_cosechados", "frutas")
    many = t.blocks_desarrollo.count()
    return (
        blocks.join(merged(t.blocks_detalle, t.blocks_detalle.count()), "blocknumber", "left")
        .join(merged(first_crop, many), ["blocknumber", "desarrollo"], "left")
        .join(merged(weights, many), "llave", "left")
        .join(merged(harvested, many), "llave", "left")
        .select(
            *carried,
            "blocknumber",
            "descripcion",
            "desarrollo",
            "llave",
            "fecha_siembra",
            "fecha_siembra_pc",
            "dias_hasta_siembra_grupo",
            "grupo_forza",
            "finduccion",
            F.date_add("finduccion", DAYS_TO_HARVEST).alias("mean_fecha_cosecha"),
            "area",
            "drenajes",
            ratio(F.col("poblacion"), F.col("area")).alias("densidad"),
            ratio(F.col("kilos_pc"), F.col("area")).alias("productividad_pc"),
            ratio(F.col("frutas_pc"), F.col("poblacion")).alias("recuperacion_pc"),
            "rango_semilla",
            "peso_forza",
            "kilos_cosechados",
            "frutas",
        )
    )


def model_base(
    t: Tables, bloques: Iterable[str] | None = None, weights: DataFrame | None = None
) -> DataFrame:
    """What the harvest model knows about blocks: dates, areas, weight before induction, own
    harvest and, for second crops, the first-crop harvest of the same field.

    `bloques` lists block keys; left out, the base covers all blocks. `weights` may be a stored
    result of `last_weight_before_induction`, so that the samples are not read for every report.
    """
    if bloques is None:
        return _base(t, t.blocks_desarrollo, weights=weights)
    rows = t.blocks_desarrollo.where(in_list(F.col("bloque"), bloques))
    return _base(t, rows, few=True, weights=weights)


def forcing_scenarios(
    t: Tables,
    as_of: dt.date,
    planted_since: dt.date = PLANTED_SINCE,
    bloques: Iterable[str] | None = None,
    scenarios: DataFrame | None = None,
) -> DataFrame:
    """The model base of every forcing candidate in five variants: induction today or up to 29
    days later, each step 200 g heavier than the last sampling. The steps are unfolded from each
    row, so no second table is joined.

    `scenarios` (bloque, `Semanas adicionales` 0 to 4, `peso forza proyectado` in grams) replaces
    the weights: its rows are the variants, whether or not the block is ready. A step sets the days
    of induction; a row without a known step fails. A row of an unknown block is left out.
    """
    if scenarios is not None:
        return _given_scenarios(t, as_of, scenarios, bloques)
    candidates = _ready(t, as_of, planted_since).select(
        "bloque", F.col("peso_planta").alias("peso_actual")
    )
    if bloques is not None:
        candidates = candidates.where(in_list(F.col("bloque"), bloques))
    rows = t.blocks_desarrollo
    rows = rows.join(merged(candidates, rows.count()), "bloque")
    base = _base(t, rows, "peso_actual", few=bloques is not None)
    today = F.lit(as_of)
    steps = [
        F.struct(
            F.lit(step).alias("Semanas adicionales"),
            (F.col("peso_actual") + F.lit(float(STEP_GRAMS * step))).alias("peso forza proyectado"),
            F.date_add(today, days).alias("finduccion"),
            F.date_add(today, days + DAYS_TO_HARVEST).alias("mean_fecha_cosecha"),
        )
        for step, days in enumerate(STEP_DAYS)
    ]
    replaced = ("peso_actual", "finduccion", "mean_fecha_cosecha", "peso_forza")
    kept = [c for c in base.columns if c not in replaced]
    return base.select(*kept, F.inline(F.array(*steps))).withColumn(
        "peso_forza", F.col("peso forza proyectado") / 1000
    )


def _given_scenarios(
    t: Tables, as_of: dt.date, scenarios: DataFrame, bloques: Iterable[str] | None
) -> DataFrame:
    """Each scenario is joined to the base of its block, which is computed once per block."""
    step = F.col("Semanas adicionales").cast("int")
    grams = F.col("peso forza proyectado").cast("double")
    given = scenarios.select(
        F.col("bloque").alias("_bloque"),
        step.alias("Semanas adicionales"),
        grams.alias("peso forza proyectado"),
    )
    if bloques is not None:
        given = given.where(in_list(F.col("_bloque"), bloques))
    named = given.select(F.col("_bloque").alias("bloque")).distinct()
    asked = given.count()
    rows = t.blocks_desarrollo.join(merged(named, asked), "bloque", "left_semi")
    base = _base(t, rows, "bloque", few=True).drop("finduccion", "mean_fecha_cosecha", "peso_forza")
    known = F.col("Semanas adicionales").between(0, len(STEP_DAYS) - 1)
    unknown = F.raise_error(F.lit("a scenario's step must be 0 to 4")).cast("int")
    days = F.when(known, F.get(F.array(*map(F.lit, STEP_DAYS)), F.col("Semanas adicionales")))
    induction = F.date_add(F.lit(as_of), days.otherwise(unknown))
    return (
        base.join(merged(given, asked), base["bloque"] == given["_bloque"])
        .drop("bloque", "_bloque")
        .withColumns(
            {
                "finduccion": induction,
                "mean_fecha_cosecha": F.date_add(induction, DAYS_TO_HARVEST),
                "peso_forza": F.col("peso forza proyectado") / 1000,
            }
        )
    )
