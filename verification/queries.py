"""The registered queries: every operator over the whole domain tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import dates, rules, text
from fieldspark.functions.markup import markup_text
from fieldspark.operators.frames import round_numbers, spread
from fieldspark.plans import (
    alerts,
    blocks,
    forcing,
    forecast,
    group_detail,
    groups,
    harvest_model,
    program,
    statements,
    status,
    weights,
)
from fieldspark.sources import blockstore, daystate, store
from fieldspark.sources.folders import new_folder
from fieldspark.sources.fixture import AS_OF, PLANTED_SINCE, fixture_tables
from fieldspark.sources.tables import Tables


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Decimals as doubles, because the two engines give them different scales."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def in_list_filter(t: Tables) -> DataFrame:
    rows = t.aplicaciones.where(rules.in_list(F.col("etapa"), alerts.PREFORZA))
    return rows.select("bloque", "grupo", "fecha", "etapa", "categoria", "codigo_cedula")


def quality_bucket_strict(t: Tables) -> DataFrame:
    return t.aplicaciones.select(
        "bloque",
        "codigo_cedula",
        "fecha",
        "calidad",
        rules.timing_strict(F.col("calidad")).alias("clase"),
    )


def quality_bucket_lenient(t: Tables) -> DataFrame:
    return t.aplicaciones.select(
        "bloque",
        "codigo_cedula",
        "fecha",
        "calidad",
        rules.timing_lenient(F.col("calidad")).alias("color"),
        rules.timing_score(F.col("calidad")).alias("calificacion"),
    )


def text_functions(t: Tables) -> DataFrame:
    group, code = F.col("grupo"), F.col("codigo_formula")
    formula_link = text.link(code, "/detalle-formula?codigo=", text.underscored(code))
    accented = F.concat(F.lit("Protección ñandú Ü "), "categoria")
    return t.aplicaciones.select(
        "bloque",
        "codigo_cedula",
        text.joined(F.col("etapa2"), group).alias("clave"),
        text.link(group, "/preforza-detalle-grupo?grupo=", group).alias("enlace"),
        text.underscored(code).alias("guiones"),
        text.spaced(text.underscored(code)).alias("espacios"),
        F.trim(F.concat(F.lit("  "), code, F.lit(" "))).alias("recortado"),
        text.lot_of_block(F.col("bloque")).alias("lote"),
        text.labelled(group, F.col("bloque")).alias("grupo_bloque"),
        text.fold_accents(accented).alias("sin_acentos"),
        text.plain_text(F.concat(F.lit("ver "), formula_link, F.lit("."))).alias("texto"),
    )


def date_functions(t: Tables) -> DataFrame:
    day = F.col("fecha")
    return t.aplicaciones.select(
        "bloque",
        "codigo_cedula",
        "fecha",
        dates.month_start(day).alias("mes"),
        F.year(day).alias("anio"),
        F.weekofyear(day).alias("semana"),
        F.extract(F.lit("yearofweek"), day).alias("anio_iso"),
        dates.in_ranges(day, dates.year_ranges(1999)).alias("en_1999"),
        dates.in_ranges(day, dates.week_ranges(1999, 53)).alias("en_semana_53"),
        *[
            F.lit(dates.program_defaults(AS_OF)[c]).alias(f"{c}_actual") for c in ("anio", "semana")
        ],
        dates.days_since(day, AS_OF).alias("dias"),
        dates.months_since(day, AS_OF).alias("meses"),
        F.date_add(day, forcing.DAYS_TO_HARVEST).alias("cosecha"),
        dates.spanish_date(day).alias("texto"),
    )


def ratio_functions(t: Tables) -> DataFrame:
    hectares = rules.net_hectares(F.col("area"), F.col("drenajes"))
    return t.blocks_detalle.select(
        "blocknumber",
        hectares.alias("area_neta"),
        rules.ratio(F.col("poblacion"), hectares).alias("densidad"),
        rules.ratio(F.col("poblacion"), F.col("area")).alias("por_area"),
        rules.ratio(F.col("area"), F.col("drenajes")).alias("por_drenaje"),
    )


def quarter_share(t: Tables) -> DataFrame:
    induced, planted = F.col("finduccion"), F.col("fecha_siembra")
    harvest = F.date_add(induced, forcing.DAYS_TO_HARVEST)
    return t.blocks_desarrollo.select(
        "bloque",
        *[dates.quarter_share(induced, harvest, q).alias(f"posforza_t{q}") for q in (1, 2, 3, 4)],
        *[
            dates.quarter_share(planted, F.col("mediana_fecha_cosecha"), q).alias(f"ciclo_t{q}")
            for q in (1, 2, 3, 4)
        ],
    )


def seed_range_features(t: Tables) -> DataFrame:
    return forecast.with_seed_range(t.blocks_detalle.select("blocknumber", "rango_semilla"))


def age_features(t: Tables) -> DataFrame:
    ages = forecast.with_ages(forcing.model_base(t))
    return ages.select("llave", "edad_forza", "edad_cosecha", "edad_inicio_sc")


def edited_scenarios(t: Tables) -> DataFrame:
    """Weights as a user may enter them: every block, two steps."""
    return t.blocks_desarrollo.select(
        "bloque",
        F.explode(F.array(F.lit(1), F.lit(3))).alias("Semanas adicionales"),
    ).withColumn(
        "peso forza proyectado",
        F.lit(2000.0) + F.length("bloque") * 10 + F.col("Semanas adicionales") * 150,
    )


def projected_kilos(t: Tables) -> DataFrame:
    scenarios = forcing.forcing_scenarios(t, AS_OF, PLANTED_SINCE)
    extra = ("Semanas adicionales", "peso forza proyectado")
    featured = forecast.model_features(scenarios, *extra)
    weights = {"peso_forza": 0.5, "drenajes": 2.0, "media_rango_semilla": 0.001, "edad_forza": -0.1}
    projected = forecast.linear_projection(featured, weights, 1.5)
    return projected.select("llave", *extra, "area", "prediccion", "kilos proyectados")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """What follows from sums in any order, to digits that all orders agree on."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names})


def last_weight_co_located(t: Tables) -> DataFrame:
    """The weights before induction from a store in buckets by block."""
    spark, names = t.pesoplanta.sparkSession, ("pesoplanta", "blocks_desarrollo")
    root = new_folder(spark, "blocks")
    buckets = blockstore.buckets_for(t, names, 16)
    blockstore.write_block_store(t, root, buckets, names)
    return blockstore.BlockStore(spark, root, buckets, names).by_block(weights.last_weight_before_induction)


def markup_cells(t: Tables) -> DataFrame:
    """Cells with every kind of markup around the values of each block."""
    group, code, day = F.col("grupo_siembra"), F.col("descripcion"), F.col("fecha_siembra").cast("string")
    link = text.link(F.concat(F.lit("**"), group, F.lit("**")), "/detalle?g=(", group, ")")
    rows = t.blocks_desarrollo.select("bloque", "desarrollo", "grupo_siembra", "descripcion", "fecha_siembra")
    cells = spread(rows).select(
        "bloque",
        F.concat(F.lit("_"), F.col("desarrollo"), F.lit("_ de "), link, F.lit(" y *"), day, F.lit("*")).alias("a"),
        F.concat(F.lit("`"), text.underscored(code), F.lit("*` \\*"), F.col("bloque"), F.lit("\\*")).alias("b"),
        F.concat(F.lit("![foto](/f?b="), F.col("bloque"), F.lit(")[_"), code, F.lit("_ ![x](y)](z) a_b_c")).alias("c"),
        F.concat(F.lit("2 * 3 **"), code, F.lit(" [sin fin")).alias("d"),
    )
    return cells.select("bloque", *[markup_text(F.col(c)).alias(c) for c in "abcd"])


def export_in_order(t: Tables) -> DataFrame:
    """Lot status, written in files of 300 rows in the order of lots and blocks, and read back."""
    spark = t.historia_bloques.sparkSession
    path = new_folder(spark, "export")
    order = [F.col(c).asc_nulls_last() for c in ("lote", "bloque")]
    store.export_files(status.lot_table(t), path, order, 300, "parquet")
    return store.read_export(spark, path).select("orden", "lote", "bloque", "grupo de siembra", "siembra")


def weight_quantiles_from_days(t: Tables) -> DataFrame:
    """Two years of stored sketches, merged over the second half of one and the first of the other."""
    spark, samples = t.pesoplanta.sparkSession, t.pesoplanta
    sketches = daystate.weight_sketches(new_folder(spark, "sketches"))
    for year in (1998, 1999):
        sketches.update(samples.where(dates.in_ranges(F.col("fecha"), dates.year_ranges(year))))
    return daystate.weight_quantiles(spark, sketches, dt.date(1998, 7, 1), dt.date(1999, 6, 30))


def by_statement(name: str, **arguments) -> Callable[[Tables], DataFrame]:
    """A report as SQL text, called with bound arguments."""

    def run(t: Tables) -> DataFrame:
        spark = t.pesoplanta.sparkSession
        statements.register(spark, t, "granja_")
        return statements.statement(spark, name, "granja_", **arguments)

    return run


def latest_weight_from_days(t: Tables) -> DataFrame:
    """Deliveries by month parity: late days after newer ones, wrong days corrected, and a repeat."""
    spark, samples = t.pesoplanta.sparkSession, t.pesoplanta
    state = daystate.weight_state(new_folder(spark, "days"))
    even = F.coalesce(F.month("fecha") % 2 == 0, F.lit(False))
    state.update(samples.where(even).withColumn("valor", F.lit(1).cast("decimal(12,2)")))  # wrong
    state.update(samples.where(~even))
    for _ in range(2):
        state.update(samples.where(even))
    return daystate.latest_weight(spark, state)


ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    # Expressions and filters.
    "in_list_filter": in_list_filter,
    "quality_bucket_strict": quality_bucket_strict,
    "quality_bucket_lenient": quality_bucket_lenient,
    "text_functions": text_functions,
    "date_functions": date_functions,
    "ratio_functions": ratio_functions,
    "rounded_ratios": lambda t: round_numbers(ratio_functions(t)),
    "quarter_share": quarter_share,
    "seed_range_features": seed_range_features,
    "age_features": age_features,
    # Group comparison.
    "group_dates": groups.group_dates,
    "group_quality": groups.group_quality,
    "groups_started_in_year": groups.groups_started_in_year,
    "group_quality_long": groups.group_quality_long,
    "group_quality_totals": groups.group_quality_totals,
    "tolerance_lookup": lambda t: groups.tolerance_lookup(t, "preforza", "nutricion"),
    "tolerances_in_use": groups.tolerances_in_use,
    "monthly_quality_rows": groups.monthly_quality_rows,
    "monthly_pending_rows": groups.monthly_pending_rows,
    "monthly_quality_by_group": groups.monthly_quality_by_group,
    "monthly_quality_area_by_lot": groups.monthly_quality_area_by_lot,
    "monthly_quality_totals": groups.monthly_quality_totals,
    "monthly_quality_share": groups.monthly_quality_share,
    "monthly_quality_share_page": lambda t: groups.monthly_quality_share(
        t, "preforza", "nutricion", 1999
    ),
    "group_quality_page": lambda t: groups.group_quality(t, "preforza", "nutricion"),
    # Group detail.
    "group_list": group_detail.group_list,
    "group_block_quality": group_detail.group_block_quality,
    "group_table": group_detail.group_table,
    "group_application_table": group_detail.group_application_table,
    "group_weights": group_detail.group_weights,
    "group_applications": group_detail.group_applications,
    # Plant weights.
    "weight_samples": weights.weight_samples,
    "weight_distribution": weights.weight_distribution,
    "weights_by_day": weights.weights_by_day,
    "last_weight_before_induction": weights.last_weight_before_induction,
    "last_weight_co_located": last_weight_co_located,
    "latest_weight_from_days": latest_weight_from_days,
    "weight_quantiles_from_days": weight_quantiles_from_days,
    "weight_before_treatment": weights.weight_before_treatment,
    # Block detail.
    "block_list": blocks.block_list,
    "block_applications": blocks.block_applications,
    "block_applications_all": blocks.block_applications_all,
    "block_pending": blocks.block_pending,
    "block_table": blocks.block_table,
    "block_timeline": blocks.block_timeline,
    "block_timeline_all": lambda t: blocks.block_timeline(t, categoria="todas"),
    "block_milestones": blocks.block_milestones,
    "block_group_by_stage": blocks.block_group_by_stage,
    # Lots and formulas.
    "lot_list": status.lot_list,
    "lot_block_status": status.lot_block_status,
    "fill_blank": status.lot_table,
    "export_plain": lambda t: store.export_plain(status.lot_block_status(t)),
    "markup_cells": markup_cells,
    "export_in_order": export_in_order,
    "formula_list": status.formula_list,
    "formula_inputs": status.formula_inputs,
    # Alerts.
    "alert_preforza": lambda t: alerts.alert_preforza(t, AS_OF),
    "alert_postforza": lambda t: alerts.alert_postforza(t, AS_OF),
    "alert_semillero": lambda t: alerts.alert_semillero(t, AS_OF),
    "alert_new_blocks": lambda t: alerts.alert_new_blocks(t, AS_OF),
    "alert_preforza_list": lambda t: alerts.alert_preforza_list(t, AS_OF),
    "alert_postforza_list": lambda t: alerts.alert_postforza_list(t, AS_OF),
    "alert_semillero_list": lambda t: alerts.alert_semillero_list(t, AS_OF),
    "alert_new_blocks_list": lambda t: alerts.alert_new_blocks_list(t, AS_OF),
    # Programme.
    "current_group": program.current_groups,
    "weekly_program_rows": program.weekly_program_rows,
    "weekly_program_area": program.weekly_program_area,
    "weekly_program": program.weekly_program,
    "weekly_program_page": lambda t: program.weekly_program(t, 1999, 20),
    # Reports as SQL text.
    "sql_last_samples": by_statement("ultimo_muestreo"),
    "sql_formula_inputs": by_statement("insumos_formula"),
    "sql_group_quality": by_statement("calidad_grupo", de_categoria="nutricion"),
    "sql_new_blocks": by_statement("bloques_nuevos", hoy=AS_OF),
    "sql_program_area": by_statement("programa_semanal"),
    "sql_program_area_page": by_statement("programa_semanal", anio=1999, semana=20),
    # Forcing and forecast.
    "forcing_candidates": lambda t: forcing.forcing_candidates(t, AS_OF, PLANTED_SINCE),
    "forcing_table": lambda t: forcing.forcing_table(t, AS_OF, PLANTED_SINCE),
    "model_base": forcing.model_base,
    "features_pc": lambda t: forecast.features_pc(forcing.model_base(t)),
    "features_sc": lambda t: forecast.features_sc(forcing.model_base(t)),
    "forcing_scenarios": lambda t: forcing.forcing_scenarios(t, AS_OF, PLANTED_SINCE),
    "forcing_scenarios_edited": lambda t: forcing.forcing_scenarios(
        t, AS_OF, PLANTED_SINCE, scenarios=edited_scenarios(t)
    ),
    "training_rows": forecast.training_rows,
    "projected_kilos": projected_kilos,
    "harvest_forecast_linear": lambda t: rounded(
        rounded(
            harvest_model.harvest_forecast_linear(t, AS_OF, PLANTED_SINCE), 3, "kilos proyectados"
        ),
        6,
        "prediccion",
    ),
    "harvest_folds": lambda t: rounded(harvest_model.harvest_folds(t), 6, "rendimiento", "prediccion"),
    "harvest_fold_errors": lambda t: rounded(
        harvest_model.harvest_fold_errors(t), 6, "error_medio", "error_cuadratico", "explicado"
    ),
    "harvest_forecast": lambda t: forecast.harvest_forecast(t, AS_OF, PLANTED_SINCE),
}


def _registered(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: decimals_as_double(plan(fixture_tables(spark, sf_dir)))


QUERIES = {name: _registered(plan) for name, plan in ON_TABLES.items()}
