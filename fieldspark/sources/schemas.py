"""Declared schema of every domain table."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "text": T.StringType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "weight": T.DecimalType(12, 2),
}


def _schema(**columns: str) -> T.StructType:
    """Columns by type, in the order in which a table presents them: `name=type`."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


_GROUP = _schema(descripcion="text", fecha="date")

# Names and types are fixed values.
SCHEMAS: dict[str, T.StructType] = {
    "aplicaciones": _schema(
        blocknumber="text",
        bloque="text",
        grupo="text",
        fecha="date",
        codigo_cedula="text",
        codigo_formula="text",
        descripcion_formula="text",
        motivo="text",
        dias_diferencia="int",
        calidad="int",
        categoria="text",
        etapa="text",
        etapa2="text",
    ),
    "aplicaciones_pendientes": _schema(
        bloque="text",
        blocknumber="text",
        grupo="text",
        fecha="date",
        categoria="text",
        etapa="text",
        etapa2="text",
    ),
    "calidad_aplicaciones": _schema(
        bloque="text",
        grupo="text",
        etapa2="text",
        categoria="text",
        fecha_siembra="date",
        finduccion="date",
        num_aplicaciones_realizadas="long",
        aplicaciones_con_retraso="long",
        aplicaciones_muy_proximas="long",
        aplicaciones_pendientes="long",
    ),
    "rangos_calidad_aplicaciones": _schema(
        etapa2="text",
        categoria="text",
        dias_entre_aplicaciones="int",
        tolerancia_rango_inferior="int",
        tolerancia_rango_superior="int",
    ),
    "blocks": _schema(codigo="text", lote="text", area="double"),
    "blocks_desarrollo": _schema(
        bloque="text",
        blocknumber="text",
        desarrollo="text",
        descripcion="text",
        grupo_siembra="text",
        grupo_forza="text",
        grupo_semillero="text",
        fecha_siembra="date",
        finduccion="date",
        mediana_fecha_cosecha="date",
        kilos_cosechados="double",
        frutas="double",
    ),
    "blocks_detalle": _schema(
        blocknumber="text",
        descripcion="text",
        area="double",
        drenajes="double",
        poblacion="double",
        dias_hasta_siembra_grupo="int",
        rango_semilla="text",
    ),
    "pesoplanta": _schema(llave="text", fecha="date", valor="weight"),
    "cosecha_resumen": _schema(
        bloque="text",
        blocknumber="text",
        desarrollo="text",
        kilos_cosechados="double",
        frutas="double",
    ),
    "siembra": _schema(blocknumber="text", estado="text"),
    "historia_bloques": _schema(
        bloque="text",
        lote="text",
        grupo_siembra="text",
        grupo_forza="text",
        grupo_semillero="text",
        grupo_2da_cosecha="text",
        grupo_forza2="text",
        siembra="date",
        finduccion="date",
        fecha_cosecha_pc="date",
        poda="date",
        deshija="date",
        finduccion2="date",
        fecha_cosecha_sc="date",
        semillerosegunda="date",
        barrido="date",
    ),
    "lotes_detalle": _schema(label="text", value="text"),
    "grupossiembra": _GROUP,
    "grupos2dacosecha": _GROUP,
    "gruposforza": _GROUP,
    "gruposforza2": _GROUP,
    "grupossemillero": _GROUP,
    "programacionaplicaciones": _schema(
        formula="text", block="text", fecha="date", area="double", codformula="text"
    ),
    "formulas": _schema(codigo="text"),
    "formulas_det": _schema(
        codigo="text", insumo="text", descripcion="text", categoria="text", cantha="double"
    ),
    "agroinsumos": _schema(insumo="text", nombre_insumo="text"),
}

# Tables that grow with every field operation; the store keeps them partitioned by year of `fecha`.
DATED = ("aplicaciones", "aplicaciones_pendientes", "pesoplanta", "programacionaplicaciones")
