"""Features of the harvest model and the forecast itself."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.dates import months_between_days, quarter_share
from fieldspark.functions.rules import ratio
from fieldspark.plans.forcing import PLANTED_SINCE, forcing_scenarios, model_base
from fieldspark.sources.tables import Tables

# Variables kept from the model base.
VARIABLES = (
    "mean_fecha_cosecha", "descripcion", "fecha_siembra", "dias_hasta_siembra_grupo",
    "finduccion", "area", "drenajes", "rango_semilla", "peso_forza", "densidad", "llave",
    "grupo_forza", "kilos_cosechados", "frutas", "fecha_siembra_pc", "productividad_pc",
    "recuperacion_pc", "desarrollo",
)

# Mean and width in grams of each seed range; other labels have none.
SEED_RANGES = (
    ("CM COLINO MEDIO ENTRE 300-500 G", 400, 200),
    ("CG COLINO GRANDE ENTRE 501-700 G", 600, 200),
    ("RANGO 1 ( DE 300 A 700)", 500, 400),
    ("RANGO 2 (DE 701 A 1000", 850, 300),
    ("RANGO 3 (DE 1001 A 1500)", 1250, 500),
    ("R-1 (DE 250 A 550)", 400, 300),
    ("R-2 (DE 551 A 900)", 725, 350),
    ("RANG. 1 (DE 400 A 600)", 500, 200),
    ("RANG. 2 (DE 601 A 900)", 750, 300),
    ("RG. 1 (250 A 600)", 425, 350),
    ("R-3 ( DE 901 A 1500)", 1200, 600),
    ("RANGO 2 (RAIZ)", 700, 200),
    ("R.2 (601-900)", 750, 300),
    ("R.3 (901-1200)", 1050, 300),
    ("R.1 (450-600)", 525, 150),
    ("R.0 (250-450)", 350, 200),
    ("R3: (601-900)", 750, 300),
    ("R2: (451-600)", 525, 150),
    ("R:4 (901-1200)", 1050, 300),
    ("R1: (250-450)", 350, 200),
)

# Numeric inputs of the two models.
COMMON_INPUTS = [
    "area", "drenajes", "peso_forza", "densidad", "media_rango_semilla", "ancho_rango_semilla",
    "edad_forza", "edad_cosecha", "proporcion_posforza_t1", "proporcion_posforza_t4",
]
FIRST_CROP_INPUTS = [*COMMON_INPUTS, "dias_hasta_siembra_grupo"]
SECOND_CROP_INPUTS = [*COMMON_INPUTS, "productividad_pc", "recuperacion_pc", "edad_inicio_sc"]
LABEL = "rendimiento"


def seed_range_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(SEED_RANGES),
        "rango_semilla string, media_rango_semilla int, ancho_rango_semilla int",
    )


def with_seed_range(df: DataFrame) -> DataFrame:
    """Adds mean and width of the seed range. The dimension is the fixed list above."""
    dimension = seed_range_dimension(df.sparkSession)
    return df.join(F.broadcast(dimension), "rango_semilla", "left")


def with_ages(df: DataFrame) -> DataFrame:
    """Adds months from planting to induction, to harvest, and between the two crops."""
    return df.withColumns(
        {
            "edad_forza": months_between_days(F.col("finduccion"), F.col("fecha_siembra")),
            "edad_cosecha": months_between_days(F.col("mean_fecha_cosecha"), F.col("finduccion")),
            "edad_inicio_sc": months_between_days(
                F.col("fecha_siembra"), F.col("fecha_siembra_pc")
            ),
        }
    )


def with_quarter_shares(df: DataFrame) -> DataFrame:
    """Adds the shares of the first and last quarter in the time from induction to harvest."""
    dates = F.col("finduccion"), F.col("mean_fecha_cosecha")
    return df.withColumns(
        {
            "proporcion_posforza_t1": quarter_share(*dates, 1),
            "proporcion_posforza_t4": quarter_share(*dates, 4),
        }
    )


def checked_crop(df: DataFrame) -> DataFrame:
    """Fails at run time on the first row whose `desarrollo` is neither PC nor SC."""
    crop = F.col("desarrollo")
    message = F.concat(F.lit("desarrollo must be PC or SC, not "), F.coalesce(crop, F.lit("null")))
    known = F.when(crop.isin("PC", "SC"), crop).otherwise(F.raise_error(message).cast("string"))
    return df.withColumn("desarrollo", known)


def counted_crops(df: DataFrame) -> tuple[DataFrame, Observation]:
    """`df` as it is, and counts that are there once it has run: `observation.get` has `filas`, `desconocidas`
    (neither PC nor SC) and `vacias` (null). For runs that report odd crops instead of failing on them."""
    crop, observation = F.col("desarrollo"), Observation()
    return df.observe(
        observation,
        F.count(F.lit(1)).alias("filas"),
        F.count_if(~crop.isin("PC", "SC")).alias("desconocidas"),
        F.count_if(crop.isNull()).alias("vacias"),
    ), observation


def model_features(base: DataFrame, *extra: str) -> DataFrame:
    """All features of the model base; `extra` columns are carried along."""
    chosen = checked_crop(base).select(*VARIABLES, *extra)
    featured = with_quarter_shares(with_ages(with_seed_range(chosen)))
    return featured.drop(
        "fecha_siembra", "finduccion", "mean_fecha_cosecha", "rango_semilla", "fecha_siembra_pc"
    )


def features_pc(base: DataFrame, *extra: str) -> DataFrame:
    """Features of first-crop blocks."""
    rows = model_features(base, *extra).where(F.col("desarrollo") == "PC")
    return rows.drop("productividad_pc", "recuperacion_pc", "edad_inicio_sc")


def features_sc(base: DataFrame, *extra: str) -> DataFrame:
    """Features of second-crop blocks."""
    rows = model_features(base, *extra).where(F.col("desarrollo") == "SC")
    return rows.drop("dias_hasta_siembra_grupo")


def _fit(rows: DataFrame, name: str, inputs: list[str], regressor) -> PipelineModel:
    """One model; its working columns carry `name`, so that both models score the same frame."""
    filled = [f"_{name}_{c}" for c in inputs]
    features = f"_{name}_features"
    regressor.setParams(featuresCol=features, predictionCol=f"_{name}", labelCol=LABEL)
    stages = [
        Imputer(inputCols=inputs, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol=features),
        regressor,
    ]
    return Pipeline(stages=stages).fit(rows)


def _numeric(df: DataFrame) -> DataFrame:
    """Model inputs as doubles, the type imputation works on."""
    inputs = dict.fromkeys([*FIRST_CROP_INPUTS, *SECOND_CROP_INPUTS])
    return df.withColumns({c: F.col(c).cast("double") for c in inputs if c in df.columns})


def training_rows(t: Tables) -> DataFrame:
    """The harvested blocks: features, and kilos per square metre as the label. Blocks without an
    area have no label and are left out."""
    harvested = model_base(t).where(F.col("kilos_cosechados").isNotNull())
    labelled = model_features(harvested).withColumn(
        LABEL, ratio(F.col("kilos_cosechados"), F.col("area"))
    )
    return _numeric(labelled.where(F.col(LABEL).isNotNull()))


def linear_projection(df: DataFrame, weights: Mapping[str, float], intercept: float) -> DataFrame:
    """Prediction of a linear model with given coefficients, and projected kilos. A missing input
    counts as zero."""
    prediction = F.lit(float(intercept))
    for name, weight in weights.items():
        prediction = prediction + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * float(weight)
    projected = df.withColumn("prediccion", prediction)
    return projected.withColumn("kilos proyectados", F.col("prediccion") * F.col("area"))


def write_models(models: tuple[PipelineModel, PipelineModel], root: str) -> None:
    """Keeps the two fitted models below `root`, a folder that all executors share."""
    for crop, model in zip(("pc", "sc"), models, strict=True):
        model.write().overwrite().save(f"{root}/{crop}")


def read_models(root: str) -> tuple[PipelineModel, PipelineModel]:
    """The models that `write_models` kept; pass them to `harvest_forecast`."""
    return PipelineModel.load(f"{root}/pc"), PipelineModel.load(f"{root}/sc")


def fit_models(t: Tables) -> tuple[PipelineModel, PipelineModel]:
    """Models of kilos per square metre, fitted on the harvested blocks: linear for first crops,
    boosted trees for second crops."""
    rows = training_rows(t).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return (
            _fit(
                rows.where(F.col("desarrollo") == "PC"),
                "pc",
                FIRST_CROP_INPUTS,
                LinearRegression(regParam=0.01),
            ),
            _fit(
                rows.where(F.col("desarrollo") == "SC"),
                "sc",
                SECOND_CROP_INPUTS,
                GBTRegressor(maxIter=20, maxDepth=4, seed=7),
            ),
        )
    finally:
        rows.unpersist()


def harvest_forecast(
    t: Tables,
    as_of: dt.date,
    planted_since: dt.date = PLANTED_SINCE,
    bloques: Iterable[str] | None = None,
    models: tuple[PipelineModel, PipelineModel] | None = None,
    scenarios: DataFrame | None = None,
) -> DataFrame:
    """Projected kilos of every forcing scenario, or of the caller's `scenarios`.

    First-crop rows take the first-crop model and second-crop rows the other, also when both
    occur together; both models run over the scenarios in one pass. Without `models` they are
    fitted first.
    """
    pc_model, sc_model = models or fit_models(t)
    extra = ("Semanas adicionales", "peso forza proyectado")
    rows = forcing_scenarios(t, as_of, planted_since, bloques, scenarios)
    scored = sc_model.transform(pc_model.transform(_numeric(model_features(rows, *extra))))
    prediction = F.when(F.col("desarrollo") == "PC", F.col("_pc")).otherwise(F.col("_sc"))
    return scored.select(
        "llave",
        "desarrollo",
        *extra,
        "area",
        prediction.alias("prediccion"),
        (prediction * F.col("area")).alias("kilos proyectados"),
    )
