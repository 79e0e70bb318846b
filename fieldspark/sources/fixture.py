"""The domain tables derived from the star-schema test tables.

Tests and benchmarks have no farm data. Each domain table is a fixed projection of `part`,
`lineitem` or `supplier`, as defined in FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.plans.forecast import SEED_RANGES
from fieldspark.sources.tables import Tables

AS_OF = dt.date(2001, 12, 31)
PLANTED_SINCE = dt.date(1998, 1, 1)


def _digits(value: str, width: int) -> str:
    return f"lpad(cast({value} as string), {width}, '0')"


def _lot(key: str) -> str:
    return f"concat('L', {_digits(f'{key} % 40', 2)})"


def _block(key: str) -> str:
    suffix = f"if({key} % 17 = 0, 'J', '')"
    return f"concat({_digits(f'{key} % 40', 2)}, {_digits(key, 5)}, {suffix})"


def _block_or_unknown(key: str, every: int) -> str:
    return f"if({key} % {every} = 0, concat('ZZ', cast({key} as string)), {_block(key)})"


def _group(prefix: str, key: str, number: int) -> str:
    return f"concat('{prefix}', {_digits(f'{key} % {number}', 2)})"


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Domain tables over the parquet files in `sf_dir`."""

    @cache
    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @cache
    def blocks() -> DataFrame:
        return stored("part").selectExpr(
            f"{_block('p_partkey')} as codigo",
            f"{_lot('p_partkey')} as lote",
            "cast(p_size * 250 as double) as area",
        )

    @cache
    def blocks_detalle() -> DataFrame:
        # Every seed range, an unknown one and null, by p_partkey % 22.
        labels = [label for label, _, _ in SEED_RANGES] + ["SIN RANGO"]
        listed = ", ".join(f"'{label}'" for label in labels)
        seed_range = f"get(array({listed}), cast(p_partkey % 22 as int))"
        return stored("part").selectExpr(
            f"{_block('p_partkey')} as blocknumber",
            f"{_block('p_partkey')} as descripcion",
            "cast(p_size * 250 as double) as area",
            "cast(p_partkey % 4 as double) / 20 as drenajes",
            "cast(p_size * (1300 + 20 * (p_partkey % 21)) as double) as poblacion",
            "cast(p_partkey % 30 as int) as dias_hasta_siembra_grupo",
            f"{seed_range} as rango_semilla",
        )

    @cache
    def blocks_desarrollo() -> DataFrame:
        first = "if(desarrollo = 'PC', date '1998-01-01', date '1999-09-01')"
        # Yield follows the drains of the block and, in first crops, its days until planting.
        kilos = (
            "if(desarrollo = 'PC', 700 + 60 * (k % 4) + 3 * (k % 30), 600 + 150 * (k % 4))"
        )
        return (
            stored("part")
            .selectExpr("p_partkey as k", "p_size", "explode(array('PC', 'SC')) as desarrollo")
            .where("desarrollo = 'PC' or k % 2 = 0")
            .selectExpr(
                "*",
                f"{_block('k')} as blocknumber",
                f"date_add({first}, cast(k % 1200 as int)) as fecha_siembra",
            )
            .selectExpr(
                "concat(desarrollo, blocknumber) as bloque",
                "blocknumber",
                "desarrollo",
                "blocknumber as descripcion",
                f"{_group('GS', 'k', 50)} as grupo_siembra",
                f"{_group('GF', 'k', 40)} as grupo_forza",
                f"{_group('GE', 'k', 30)} as grupo_semillero",
                "fecha_siembra",
                "if(k % 3 = 0, null, date_add(fecha_siembra, 300)) as finduccion",
                "if(k % 3 = 1, date_add(fecha_siembra, 440), null) as mediana_fecha_cosecha",
                f"cast(p_size * {kilos} as double) as kilos_cosechados",
                "cast(p_size * (600 + 10 * (k % 23)) as double) as frutas",
            )
        )

    @cache
    def aplicaciones() -> DataFrame:
        crop = "if(l_linestatus = 'F' or l_partkey % 2 = 1, 'PC', 'SC')"
        prefix = "case l_returnflag when 'A' then 'GS' when 'N' then 'GF' else 'GE' end"
        # Stages by return flag and line status.
        etapa = (
            "case l_returnflag when 'A' then if(l_linestatus = 'F', 'Post Siembra', 'Post Deshija') "
            "when 'N' then if(l_linestatus = 'F', 'Post Forza', 'Post 2da Forza') "
            "else 'Post Poda' end"
        )
        etapa2 = (
            "case l_returnflag when 'A' then 'preforza' when 'N' then 'postforza' "
            "else 'semillero' end"
        )
        categoria = (
            "case when l_linenumber <= 4 then 'nutricion' when l_linenumber = 5 then 'proteccion' "
            "else 'herbicida' end"
        )
        group = f"concat({prefix}, {_digits('l_suppkey % 50', 2)})"
        # One part in eleven is treated under a key that no block has: its blocks are new ones.
        block = _block_or_unknown("l_partkey", 11)
        return (
            stored("lineitem")
            .selectExpr(
                f"{block} as blocknumber",
                f"concat({crop}, {block}) as bloque",
                f"if(l_suppkey % 13 = 0, null, {group}) as grupo",
                "cast(l_shipdate as date) as fecha",
                "cast(l_orderkey as string) as codigo_cedula",
                "concat('F ', cast(l_suppkey % 25 as string)) as codigo_formula",
                "concat('FORMULA ', cast(l_suppkey % 25 as string)) as descripcion_formula",
                "if(l_quantity > 25, 'PLAN', null) as motivo",
                "cast(l_quantity as int) as dias_diferencia",
                "if(l_quantity % 7 = 6, null, cast(l_quantity % 7 as int)) as calidad",
                f"{categoria} as categoria",
                f"{etapa} as etapa",
                f"{etapa2} as etapa2",
            )
        )

    @cache
    def aplicaciones_pendientes() -> DataFrame:
        return (
            aplicaciones()
            .selectExpr(
                "bloque",
                "blocknumber",
                "grupo",
                "date_add(fecha, 15) as fecha",
                "categoria",
                "etapa",
                "etapa2",
            )
        )

    @cache
    def calidad_aplicaciones() -> DataFrame:
        keys = ["bloque", "grupo", "etapa2", "categoria"]
        # Counted before the join, so that a busy block joins as a few rows.
        counted = (
            aplicaciones()
            .groupBy(*keys)
            .agg(
                F.expr("count(*) as hechas"),
                F.expr("count_if(calidad in (3, 4)) as tarde"),
                F.expr("count_if(calidad in (0, 1)) as pronto"),
                F.expr("count_if(calidad is null) as sin_dato"),
            )
        )
        dates = (
            blocks_desarrollo()
            .groupBy("bloque")
            .agg(
                F.expr("min(fecha_siembra) as fecha_siembra"),
                F.expr("min(finduccion) as finduccion"),
                F.expr("count(*) as copias"),
            )
        )
        return counted.join(dates, "bloque", "left").selectExpr(
            *keys,
            "fecha_siembra",
            "finduccion",
            "hechas * coalesce(copias, 1L) as num_aplicaciones_realizadas",
            "tarde * coalesce(copias, 1L) as aplicaciones_con_retraso",
            "pronto * coalesce(copias, 1L) as aplicaciones_muy_proximas",
            "sin_dato * coalesce(copias, 1L) as aplicaciones_pendientes",
        )

    def rangos_calidad_aplicaciones() -> DataFrame:
        # Days between treatments and tolerances.
        return spark.createDataFrame(
            [
                ("preforza", "nutricion", 15, 3, 4),
                ("postforza", "nutricion", 12, 2, 3),
                ("semillero", "nutricion", 20, 4, 5),
                ("preforza", "proteccion", 30, 5, 6),
                ("preforza", "herbicida", 60, 9, 9),
            ],
            "etapa2 string, categoria string, dias_entre_aplicaciones int, "
            "tolerancia_rango_inferior int, tolerancia_rango_superior int",
        )

    def groups(prefix: str, number: int, odd_days: int = 0) -> DataFrame:
        days = f"cast((s_suppkey % {number}) * 20 + (s_suppkey % 2) * {odd_days} as int)"
        return stored("supplier").selectExpr(
            f"{_group(prefix, 's_suppkey', number)} as descripcion",
            f"date_add(date '1998-01-01', {days}) as fecha",
        )

    def pesoplanta() -> DataFrame:
        return (
            aplicaciones()
            .selectExpr(
                "bloque as llave",
                "fecha",
                "cast(500 + dias_diferencia * 50 as decimal(12,2)) as valor",
            )
        )

    def historia_bloques() -> DataFrame:
        def day(first: str) -> str:
            return f"date_add(date '{first}', cast(p_partkey % 1200 as int))"

        return stored("part").selectExpr(
            f"{_block('p_partkey')} as bloque",
            f"{_lot('p_partkey')} as lote",
            f"if(p_partkey % 19 = 0, null, {_group('GS', 'p_partkey', 50)}) as grupo_siembra",
            f"{_group('GF', 'p_partkey', 40)} as grupo_forza",
            f"if(p_partkey % 4 = 0, {_group('GE', 'p_partkey', 30)}, null) as grupo_semillero",
            f"{_group('GS', 'p_partkey', 45)} as grupo_2da_cosecha",
            f"{_group('GF', 'p_partkey', 35)} as grupo_forza2",
            f"if(p_partkey % 23 = 0, null, {day('1998-01-01')}) as siembra",
            f"if(p_partkey % 5 >= 1, {day('1998-10-28')}, null) as finduccion",
            f"if(p_partkey % 5 >= 2, {day('1999-03-17')}, null) as fecha_cosecha_pc",
            f"if(p_partkey % 10 = 2, {day('1999-05-01')}, null) as poda",
            f"if(p_partkey % 5 >= 3, {day('1999-09-01')}, null) as deshija",
            f"if(p_partkey % 5 = 4, {day('2000-06-27')}, null) as finduccion2",
            "cast(null as date) as fecha_cosecha_sc",
            "cast(null as date) as semillerosegunda",
            "cast(null as date) as barrido",
        )

    def programacionaplicaciones() -> DataFrame:
        return (
            stored("lineitem")
            .selectExpr(
                "concat('FORMULA ', cast(l_suppkey % 25 as string)) as formula",
                f"{_block_or_unknown('l_partkey', 29)} as block",
                "cast(l_shipdate as date) as fecha",
                "cast(l_quantity * 100 as double) as area",
                "concat('F ', cast(l_suppkey % 25 as string)) as codformula",
            )
        )

    def lotes_detalle() -> DataFrame:
        return blocks().selectExpr("lote as label", "lote as value").distinct()

    def formulas() -> DataFrame:
        code = "concat('F ', cast(s_suppkey % 25 as string)) as codigo"
        return stored("supplier").selectExpr(code).distinct()

    def formulas_det() -> DataFrame:
        return stored("part").selectExpr(
            "concat('F ', cast(p_partkey % 25 as string)) as codigo",
            "concat(' ', p_brand, if(p_partkey % 2 = 0, ' ', '')) as insumo",
            "concat('FORMULA ', cast(p_partkey % 25 as string)) as descripcion",
            "lower(p_type) as categoria",
            "cast(p_size as double) / 4 as cantha",
        )

    def agroinsumos() -> DataFrame:
        return (
            stored("part")
            .selectExpr(
                "concat(if(p_brand = 'Brand#3', 'Brand#?', p_brand), ' ') as insumo",
                "concat('INSUMO ', p_brand) as nombre_insumo",
            )
            .distinct()
        )

    def cosecha_resumen() -> DataFrame:
        harvested = "finduccion is not null and mediana_fecha_cosecha is not null"
        return (
            blocks_desarrollo()
            .where(harvested)
            .select("bloque", "blocknumber", "desarrollo", "kilos_cosechados", "frutas")
        )

    def siembra() -> DataFrame:
        state = "cast(dias_hasta_siembra_grupo % 9 as string) as estado"
        return blocks_detalle().selectExpr("blocknumber", state)

    definitions = {
        "blocks": blocks,
        "blocks_detalle": blocks_detalle,
        "blocks_desarrollo": blocks_desarrollo,
        "aplicaciones": aplicaciones,
        "aplicaciones_pendientes": aplicaciones_pendientes,
        "calidad_aplicaciones": calidad_aplicaciones,
        "rangos_calidad_aplicaciones": rangos_calidad_aplicaciones,
        "grupossiembra": lambda: groups("GS", 48),
        "grupos2dacosecha": lambda: groups("GS", 45, 3),
        "gruposforza": lambda: groups("GF", 40),
        "gruposforza2": lambda: groups("GF", 35),
        "grupossemillero": lambda: groups("GE", 30, 2),
        "pesoplanta": pesoplanta,
        "historia_bloques": historia_bloques,
        "programacionaplicaciones": programacionaplicaciones,
        "lotes_detalle": lotes_detalle,
        "formulas": formulas,
        "formulas_det": formulas_det,
        "agroinsumos": agroinsumos,
        "cosecha_resumen": cosecha_resumen,
        "siembra": siembra,
    }
    return Tables(lambda name: definitions[name]())
