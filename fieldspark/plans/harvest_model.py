"""The harvest forecast by linear models of both crops, and how far off it is.

Unlike the trees of ``forecast``, these models follow from sums, so every row can be checked.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.rules import ratio
from fieldspark.operators.leastsquares import LinearFit, Moments, collected, moments, prediction
from fieldspark.plans.forcing import PLANTED_SINCE, forcing_scenarios
from fieldspark.plans.forecast import (
    FIRST_CROP_INPUTS,
    LABEL,
    SECOND_CROP_INPUTS,
    model_features,
    training_rows,
)
from fieldspark.sources.tables import Tables

INPUTS = {"PC": FIRST_CROP_INPUTS, "SC": SECOND_CROP_INPUTS}
COLUMNS = [*dict.fromkeys([*FIRST_CROP_INPUTS, *SECOND_CROP_INPUTS]), LABEL]
RIDGE = 0.01


def fold_of(key: Column, folds: int) -> Column:
    """A number from 0 to folds - 1 that follows from the text of ``key``."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("int") % folds).alias("parte")


def _fit(of: Moments, crop: str, ridge: float) -> LinearFit | None:
    return of.fit(COLUMNS, INPUTS[crop], LABEL, ridge)


def fit_linear(t: Tables, ridge: float = RIDGE) -> dict[str, LinearFit]:
    """A model of kilos per square metre for each crop that has harvested blocks."""
    sums = collected(moments(training_rows(t), COLUMNS, ["desarrollo"]), ["desarrollo"])
    return {crop: _fit(of, crop, ridge) for (crop,), of in sums.items()}


def harvest_forecast_linear(
    t: Tables,
    as_of: dt.date,
    planted_since: dt.date = PLANTED_SINCE,
    bloques: Iterable[str] | None = None,
    fits: Mapping[str, LinearFit] | None = None,
    scenarios: DataFrame | None = None,
) -> DataFrame:
    """Projected kilos of every forcing scenario, or of the caller's ``scenarios``, each by the model of its
    crop. Without ``fits`` the models are fitted first. A crop without a model gets nulls."""
    fits = fits if fits is not None else fit_linear(t)
    extra = ("Semanas adicionales", "peso forza proyectado")
    rows = model_features(forcing_scenarios(t, as_of, planted_since, bloques, scenarios), *extra)
    by_crop = F.lit(None).cast("double")
    for crop, fit in fits.items():
        by_crop = F.when(F.col("desarrollo") == crop, fit.prediction()).otherwise(by_crop)
    return rows.select(
        "llave", "desarrollo", *extra, "area", by_crop.alias("prediccion")
    ).withColumn("kilos proyectados", F.col("prediccion") * F.col("area"))


def harvest_folds(t: Tables, folds: int = 5, ridge: float = RIDGE) -> DataFrame:
    """(llave, desarrollo, parte, rendimiento, prediccion) of all harvested blocks, each predicted by a model that has
    not seen its fold.

    One pass gives the sums of every crop and fold; a fold's model comes from the total less its own. Rows
    of one block are in one fold. Without rows in the other folds the prediction is null.
    """
    rows = training_rows(t).withColumn("parte", fold_of(F.col("llave"), folds))
    by = ["desarrollo", "parte"]
    sums = collected(moments(rows, COLUMNS, by), by)
    models = []
    for crop, inputs in INPUTS.items():
        total = Moments()
        for (other, _), of in sums.items():
            if other == crop:
                total = total.plus(of)
        for (other, part), of in sums.items():
            fit = _fit(total.plus(of, -1), crop, ridge) if other == crop else None
            if fit:
                terms = {c: (fit.weights[c], fit.means[c]) if c in inputs else (0.0, 0.0) for c in COLUMNS[:-1]}
                models.append((crop, part, fit.base, [w for w, _ in terms.values()], [m for _, m in terms.values()]))
    schema = "desarrollo string, parte int, _base double, _weights array<double>, _means array<double>"
    models = rows.sparkSession.createDataFrame(models, schema)  # two crops times the folds
    terms = {c: (F.col("_weights")[k], F.col("_means")[k]) for k, c in enumerate(COLUMNS[:-1])}
    return rows.join(F.broadcast(models), by, "left").select(
        "llave", *by, LABEL, prediction(F.col("_base"), terms).alias("prediccion")
    )


def harvest_fold_errors(t: Tables, folds: int = 5, ridge: float = RIDGE) -> DataFrame:
    """Rows, mean and root mean square error of each crop over all folds, and the share of the labels'
    variance that the predictions explain."""
    rows = harvest_folds(t, folds, ridge).where(F.col("prediccion").isNotNull())
    gap, label = F.col("prediccion") - F.col(LABEL), F.col(LABEL)
    sums = rows.groupBy("desarrollo").agg(
        F.count("*").alias("filas"),
        F.sum(F.abs(gap)).alias("_abs"),
        F.sum(gap * gap).alias("_square"),
        F.var_pop(label).alias("_variance"),
    )
    mean_square = F.col("_square") / F.col("filas")
    return sums.select(
        "desarrollo",
        "filas",
        (F.col("_abs") / F.col("filas")).alias("error_medio"),
        F.sqrt(mean_square).alias("error_cuadratico"),
        (1 - ratio(mean_square, F.col("_variance"))).alias("explicado"),
    )
