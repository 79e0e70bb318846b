"""Rules of the trade as expressions: treatment timing, current group, areas and ratios."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timing classes of a treatment.
EARLY = "adelantada"
ON_TIME = "en el rango"
LATE = "tardía"
PENDING = "pendiente"
CHECK = "validar"
UNRATED = "sin calificar"
CHECK_GROUP = "VALIDAR GRUPO"
UNKNOWN_GROUP = "desconocido"


def in_list(column: Column, values: Iterable) -> Column:
    """Membership in a list of parameter values; an empty list matches nothing."""
    distinct = list(dict.fromkeys(values))
    return column.isin(distinct) if distinct else F.lit(False)


def timing_strict(calidad: Column) -> Column:
    """Timing class; anything but 0 to 4, null included, is to be checked."""
    return (
        F.when(calidad.isin(0, 1), EARLY)
        .when(calidad == 2, ON_TIME)
        .when(calidad.isin(3, 4), LATE)
        .otherwise(CHECK)
    )


def timing_lenient(calidad: Column) -> Column:
    """Timing class; anything but 0, 1, 3, 4, null included, counts as on time."""
    return F.when(calidad.isin(0, 1), EARLY).when(calidad.isin(3, 4), LATE).otherwise(ON_TIME)


def timing_score(calidad: Column) -> Column:
    """1 early, 2 on time, 3 late, by the lenient classes."""
    return F.when(calidad.isin(0, 1), 1).when(calidad.isin(3, 4), 3).otherwise(2)


def current_group() -> Column:
    """Group a block belongs to after its latest milestone.

    The milestone decides, so a reached milestone without a group gives null and does not fall
    back to an earlier group.
    """
    return (
        F.when(F.col("finduccion2").isNotNull(), F.col("grupo_forza2"))
        .when(F.col("deshija").isNotNull(), F.col("grupo_2da_cosecha"))
        .when(F.col("poda").isNotNull(), F.col("grupo_semillero"))
        .when(F.col("finduccion").isNotNull(), F.col("grupo_forza"))
        .when(F.col("siembra").isNotNull(), F.col("grupo_siembra"))
        .otherwise(CHECK_GROUP)
    )


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as double; null for a zero divisor, so one bad row does not stop a report."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def net_hectares(area: Column, drenajes: Column) -> Column:
    """Hectares of a block in square metres without the share taken by drains."""
    return area * (1 - drenajes) / 10000
