import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldspark.plans import alerts, blocks, forcing, forecast, group_detail, groups, program
from fieldspark.plans import status, weights
from fieldspark.sources.fixture import AS_OF, PLANTED_SINCE
from fieldspark.sources.schemas import SCHEMAS
from fieldspark.sources.tables import frame_tables
from verification.compare import rows_of, spark_frame
from verification.queries import QUERIES


def same(a, b):
    assert a.columns == b.columns
    assert rows_of(spark_frame(a)) == rows_of(spark_frame(b))


def made(spark, **rows):
    """Tables with the given rows (dicts; missing columns are null) and the rest empty."""
    frames = {}
    for name, schema in SCHEMAS.items():
        data = [tuple(r.get(c) for c in schema.fieldNames()) for r in rows.get(name, [])]
        frames[name] = spark.createDataFrame(data, schema)
    return frame_tables(frames)


DAY = dt.date(2020, 5, 10)


def treatment(bloque, fecha, **more):
    return {
        "bloque": bloque, "blocknumber": bloque and bloque[2:], "grupo": "G1", "fecha": fecha,
        "categoria": "nutricion", "etapa": "Post Siembra", "etapa2": "preforza",
        "codigo_formula": "F 1", "descripcion_formula": "FORMULA 1", **more,
    }


# Parameters select a slice of the whole report.


@pytest.mark.parametrize(
    "report",
    [
        groups.group_quality,
        groups.monthly_quality_rows,
        groups.monthly_pending_rows,
        groups.monthly_quality_by_group,
        groups.monthly_quality_area_by_lot,
        groups.monthly_quality_share,
    ],
)
def test_stage_and_category_select_a_slice(tables, report):
    whole = report(tables).where("etapa2 = 'preforza' and categoria = 'nutricion'")
    same(report(tables, "preforza", "nutricion"), whole.drop("etapa2", "categoria"))


def test_year_selects_a_slice(tables):
    whole = groups.monthly_quality_by_group(tables).where("year(mes) = 1999")
    same(groups.monthly_quality_by_group(tables, anio=1999), whole)
    started = groups.group_quality_long(tables).where("anio = 1999").drop("anio")
    same(groups.group_quality_long(tables, 1999), started)


def test_block_and_group_select_a_slice(tables):
    bloque = tables.aplicaciones.where("etapa2 = 'preforza'").first().bloque
    whole = blocks.block_applications(tables).where(F.col("bloque") == bloque)
    whole = whole.where("etapa2 = 'preforza' and categoria = 'nutricion'")
    same(
        blocks.block_applications(tables, bloque, "preforza", "nutricion"),
        whole.drop("bloque", "etapa2", "categoria"),
    )
    every = blocks.block_table(tables, bloque, "preforza", "todas")
    assert "color" not in every.columns
    assert every.count() == blocks.block_applications_all(tables, bloque, "preforza").count()
    same(
        blocks.block_milestones(tables, bloque, "postforza"),
        blocks.block_milestones(tables).where(
            (F.col("bloque") == bloque) & (F.col("etapa2") == "postforza")
        ),
    )
    assert blocks.block_milestones(tables, bloque, "semillero").count() == 0
    for column in ("GS07", "GF03"):
        of_group = group_detail.group_weights(tables).where(F.col("grupo_siembra") == column)
        same(group_detail.group_weights(tables, column), of_group.drop("grupo_siembra"))
    grupo = "GS07"
    listed = group_detail.group_applications(tables).where(
        (F.col("grupo") == grupo) & (F.col("etapa2") == "preforza")
    )
    same(
        group_detail.group_applications(tables, grupo, "preforza", "nutricion"),
        listed.where("categoria = 'nutricion'").drop("grupo", "etapa2", "categoria"),
    )
    same(
        weights.weight_distribution(tables, bloque),
        weights.weight_distribution(tables).where(F.col("llave") == bloque),
    )
    same(
        status.lot_block_status(tables, "L03"),
        status.lot_block_status(tables).where("lote = 'L03'").drop("lote"),
    )
    same(
        status.formula_inputs(tables, "F 3"),
        status.formula_inputs(tables).where("codigo_formula = 'F 3'"),
    )


def test_expected_row_counts(tables):
    """The row counts FIXTURES.md gives for sf0.001."""
    assert forcing.forcing_candidates(tables, AS_OF, PLANTED_SINCE).count() == 95
    assert alerts.alert_preforza(tables, AS_OF).count() == 86
    assert alerts.alert_postforza(tables, AS_OF).count() == 130
    assert alerts.alert_semillero(tables, AS_OF).count() == 45
    assert alerts.alert_new_blocks(tables, AS_OF).count() == 11
    assert groups.group_dates(tables).count() == 35
    assert groups.group_quality(tables, "preforza", "nutricion").count() == 15
    assert status.formula_inputs(tables, "F 3").count() == 8
    assert group_detail.group_weights(tables, "GS07").count() == 125
    assert weights.last_weight_before_induction(tables).count() == 271
    assert forcing.model_base(tables).count() == 300


def test_weekly_page_is_a_slice(tables):
    texts = tables.programacionaplicaciones.where("year(fecha) = 1999 and weekofyear(fecha) = 20")
    rows = program.weekly_program_rows(tables, 1999, 20)
    assert rows.select("fecha").distinct().count() == texts.select("fecha").distinct().count()
    same(rows, program.weekly_program_rows(tables).where("year(fecha) = 1999 and weekofyear(fecha) = 20"))


# Group comparison.


def test_group_with_two_dates_gives_two_rows(spark):
    quality = {"grupo": "G1", "bloque": "PC01", "etapa2": "preforza", "categoria": "nutricion"}
    t = made(
        spark,
        calidad_aplicaciones=[quality, {**quality, "bloque": None, "finduccion": DAY}],
        grupossiembra=[
            {"descripcion": "G1", "fecha": DAY},
            {"descripcion": "G1", "fecha": dt.date(2020, 6, 1)},
        ],
        gruposforza=[
            {"descripcion": "G1", "fecha": DAY},
            {"descripcion": "G1", "fecha": dt.date(2020, 6, 1)},
        ],
    )
    rows = groups.group_quality(t, "preforza", "nutricion").collect()
    assert [r["fecha inicio grupo"] for r in rows] == [DAY, dt.date(2020, 6, 1)]
    assert {(r.numero_bloques, r.bloques_por_forzar) for r in rows} == {(1, 0)}
    assert rows[0].grupo == "[G1](/preforza-detalle-grupo?grupo=G1#nutricion)"


def test_group_without_date_comes_last(spark):
    row = {"bloque": "PC01", "etapa2": "p", "categoria": "c"}
    t = made(
        spark,
        calidad_aplicaciones=[{**row, "grupo": "A"}, {**row, "grupo": "B"}, {**row, "grupo": None}],
        grupossiembra=[{"descripcion": "B", "fecha": DAY}],
    )
    got = [r["nombre grupo"] for r in groups.group_quality(t, "p", "c").collect()]
    assert got[0] == "B" and set(got[1:]) == {"A", None}


def test_monthly_sums_drop_null_keys_and_keep_fan_out(spark):
    t = made(
        spark,
        aplicaciones=[
            treatment("PC01", DAY, calidad=2),
            treatment("PC01", DAY, calidad=None),
            treatment("PC01", DAY, calidad=2, grupo=None),
            treatment("PC02", DAY, calidad=2),
        ],
        aplicaciones_pendientes=[
            {"bloque": "PC09", "blocknumber": "09", "grupo": "G2", "fecha": DAY,
             "categoria": "nutricion", "etapa2": "preforza"},
        ],
        blocks=[
            {"codigo": "01", "lote": "L1", "area": 10000.0},
            {"codigo": "01", "lote": "L2", "area": None},
            {"codigo": "02", "lote": None, "area": 5000.0},
        ],
    )
    by_group = groups.monthly_quality_by_group(t, "preforza", "nutricion", 2020).collect()
    assert sorted((r.grupo, r.calidad, r.conteo) for r in by_group) == [
        ("G1", "en el rango", 3),  # block 01 is listed twice
        ("G1", "validar", 2),
        ("G2", "pendiente", 1),
    ]
    by_lot = groups.monthly_quality_area_by_lot(t, "preforza", "nutricion", 2020).collect()
    assert sorted((r.lote, r.calidad, r.area_aplicacion) for r in by_lot) == [
        ("L1", "en el rango", 2.0),
        ("L1", "validar", 1.0),
        ("L2", "en el rango", 0.0),  # areas all missing
        ("L2", "validar", 0.0),
    ]
    only_pending = groups.monthly_quality_totals(
        made(spark, aplicaciones_pendientes=[{"grupo": "G", "fecha": DAY, "etapa2": "p", "categoria": "c"}]),
        "p", "c",
    )
    assert [r.conteo for r in only_pending.collect()] == [1]


def test_tolerance_lookup(tables):
    row = groups.tolerance_lookup(tables, "preforza", "nutricion").collect()
    assert [tuple(r) for r in row] == [(15, 3, 4)]
    assert groups.tolerance_lookup(tables, "semillero", "herbicida").count() == 0


# Alerts.


def test_age_limit_prunes_without_changing_the_alert(tables):
    for report in (alerts.alert_preforza, alerts.alert_postforza, alerts.alert_semillero):
        whole = report(tables, AS_OF).where("dias_desde_ultima_aplicacion <= 100")
        same(report(tables, AS_OF, max_days=100), whole)


def test_undated_treatment_hides_its_block(spark):
    t = made(
        spark,
        aplicaciones=[
            treatment("PC0101", DAY),
            treatment("PC0102", DAY),
            treatment("PC0102", None),
            treatment("PC0103", DAY - dt.timedelta(days=300)),
            treatment("PC0104", DAY + dt.timedelta(days=5)),
        ],
        blocks_desarrollo=[{"bloque": f"PC010{i}"} for i in (1, 2, 3, 4)],
    )
    for limited in (
        alerts.alert_preforza(t, DAY, max_days=100),
        alerts.alert_preforza(t, DAY).where("dias_desde_ultima_aplicacion <= 100"),
    ):
        assert sorted(r.bloque for r in limited.collect()) == ["PC0101", "PC0104"]


def test_last_treatment_is_last_within_stage_and_category(spark):
    t = made(
        spark,
        aplicaciones=[
            treatment("PC0101", DAY, descripcion_formula="A"),
            treatment("PC0101", DAY + dt.timedelta(days=1), categoria="herbicida"),
            treatment("PC0101", DAY + dt.timedelta(days=2), etapa="Post Forza"),
            treatment("PC0101", DAY + dt.timedelta(days=3), grupo=None),
        ],
        blocks_desarrollo=[{"bloque": "PC0101"}],
    )
    assert [r.fecha for r in alerts.alert_preforza(t, DAY).collect()] == [DAY]


def test_block_of_two_fields_in_the_nursery(spark):
    t = made(
        spark,
        aplicaciones=[
            treatment("PC0101", DAY, etapa="Post Poda", blocknumber="0199"),
            treatment("PC0101", DAY - dt.timedelta(days=9), etapa="Post Poda"),
        ],
        siembra=[{"blocknumber": "0101", "estado": "7"}, {"blocknumber": "0199", "estado": "1"}],
    )
    got = alerts.alert_semillero(t, DAY).collect()
    assert [r.dias_desde_ultima_aplicacion for r in got] == [9]


def test_null_block_in_the_harvest_summary_silences_the_alert(spark):
    rows = {"aplicaciones": [treatment("PC0101", DAY, etapa="Post Forza")]}
    for summary, n in (([], 1), ([{"bloque": "PC0102"}], 1), ([{"bloque": None}], 0)):
        t = made(spark, cosecha_resumen=summary, **rows)
        assert alerts.alert_postforza(t, DAY).count() == n


def test_new_blocks(spark):
    grown = [{"bloque": "PC0101", "fecha_siembra": DAY}, {"bloque": "PC0102", "fecha_siembra": DAY}]
    t = made(spark, blocks_desarrollo=grown, aplicaciones=[treatment("PC0101", DAY)])
    later = DAY + dt.timedelta(days=3)
    assert [tuple(r) for r in alerts.alert_new_blocks(t, later).collect()] == [("PC0102", DAY, 3)]
    t = made(spark, blocks_desarrollo=grown, aplicaciones=[treatment(None, DAY)])
    assert alerts.alert_new_blocks(t, later).count() == 0
    t = made(spark, blocks_desarrollo=grown)
    listed = alerts.alert_new_blocks_list(t, later).collect()
    assert [tuple(r) for r in listed] == [("10-mayo-2020", 3, "PC0101", 1), ("10-mayo-2020", 3, "PC0102", 1)]
    text = alerts.alert_new_blocks_text(t, later).collect()
    assert [tuple(r) for r in text] == [("10-mayo-2020", 3, "PC0101, PC0102")]


def test_alert_text(spark):
    t = made(
        spark,
        aplicaciones=[
            treatment("PC0102", DAY),
            treatment("PC0101", DAY),
            treatment("PC0103", DAY, grupo="G0"),
            treatment("PC0201", DAY),
        ],
        blocks_desarrollo=[{"bloque": b} for b in ("PC0101", "PC0102", "PC0103", "PC0201")],
    )
    later = DAY + dt.timedelta(days=2)
    got = alerts.alert_preforza_list(t, later).collect()
    assert [tuple(r) for r in got] == [
        ("10-mayo-2020", "FORMULA 1", "01", 2, "G0", "PC0103", 1),
        ("10-mayo-2020", "FORMULA 1", "01", 2, "G1", "PC0101", 1),
        ("10-mayo-2020", "FORMULA 1", "01", 2, "G1", "PC0102", 1),
        ("10-mayo-2020", "FORMULA 1", "02", 2, "G1", "PC0201", 1),
    ]
    text = alerts.alert_text(alerts.alert_preforza(t, later, max_days=100), by_lot=True).collect()
    assert [tuple(r) for r in text] == [
        ("10-mayo-2020", "FORMULA 1", "01", 2,
         "G0:PC0103\n---------------------\nG1:PC0101, PC0102"),
        ("10-mayo-2020", "FORMULA 1", "02", 2, "G1:PC0201"),
    ]


# Programme.


def test_program_text(spark):
    plan = {"formula": "X", "codformula": "F 1", "fecha": DAY}
    t = made(
        spark,
        programacionaplicaciones=[
            {**plan, "block": "02", "area": 10.005},
            {**plan, "block": "02", "area": 10.005},
            {**plan, "block": "01", "area": 1.0},
            {**plan, "block": "77", "area": 2.0},
        ],
        historia_bloques=[
            {"bloque": b, "grupo_siembra": "G1", "siembra": DAY} for b in ("01", "02")
        ],
    )
    rows = program.weekly_program_rows(t, 2020, 19).collect()
    assert sorted((r.grupo or "", r.bloque, r.veces) for r in rows) == [
        ("", "77", 1),
        ("G1", "01", 1),
        ("G1", "02", 1),
    ]
    area = program.weekly_program_area(t, 2020, 19).collect()
    assert sorted((r.grupo or "", float(r.area), r.entradas) for r in area) == [
        ("", 2.0, 1),
        ("G1", 11.01, 2),
    ]
    text = program.weekly_program_text(t, 2020, 19).collect()
    assert [r["bloques programados"] for r in text] == [
        "G1:01, 02 \n \n  VALIDAR GRUPO:77"
    ]
    assert program.weekly_program(t, 2020, 20).count() == 0


# Forcing and forecast.


def test_last_weight_before_induction(spark):
    def sample(llave, days, valor):
        return {"llave": llave, "fecha": DAY + dt.timedelta(days=days), "valor": valor}

    from decimal import Decimal as D

    t = made(
        spark,
        blocks_desarrollo=[
            {"bloque": "A", "finduccion": DAY},
            {"bloque": "B"},
            {"bloque": "C", "finduccion": DAY},
            {"bloque": "C", "finduccion": DAY + dt.timedelta(days=5)},
        ],
        pesoplanta=[
            sample("A", -9, D("900")), sample("A", -2, D("1000")), sample("A", -2, D("2000")),
            sample("A", 0, D("9000")), sample("B", 50, D("500")), sample("C", 3, D("700")),
            sample("Z", 1, D("1")), {"llave": "B", "fecha": None, "valor": D("1")},
        ],
    )
    got = {r.llave: r.peso_forza for r in weights.last_weight_before_induction(t).collect()}
    assert got == {"A": 1.5, "B": 0.5, "C": 0.7}


def test_model_base_of_listed_blocks(tables):
    keys = [r.bloque for r in tables.blocks_desarrollo.limit(7).collect()]
    whole = forcing.model_base(tables)
    same(forcing.model_base(tables, [*keys, keys[0]]), whole.where(F.col("llave").isin(keys)))
    assert forcing.model_base(tables, []).count() == 0
    stored = weights.last_weight_before_induction(tables)
    same(forcing.model_base(tables, weights=stored), whole)


def test_scenarios_of_one_block(tables):
    row = forcing.forcing_candidates(tables, AS_OF, PLANTED_SINCE).first()
    steps = forcing.forcing_scenarios(tables, AS_OF, PLANTED_SINCE, [row.bloque])
    got = steps.orderBy("Semanas adicionales").collect()
    assert [(r.finduccion - AS_OF).days for r in got] == [0, 7, 15, 21, 29]
    assert {(r.mean_fecha_cosecha - r.finduccion).days for r in got} == {140}
    grams = row["peso promedio ultimo muestreo"]
    if grams is not None:
        assert [r.peso_forza for r in got] == [(grams + 200 * i) / 1000 for i in range(5)]
    whole = forcing.forcing_scenarios(tables, AS_OF, PLANTED_SINCE)
    same(steps, whole.where(F.col("llave") == row.bloque))


def test_unknown_crop_is_an_error(spark, tables):
    base = forcing.model_base(tables)
    bad = base.withColumn("desarrollo", F.lit("XX"))
    for features in (forecast.features_pc, forecast.features_sc):
        with pytest.raises(PySparkException, match="must be PC or SC, not XX"):
            features(bad).collect()


def test_given_scenarios(spark, tables):
    blocks = [r.bloque for r in tables.blocks_desarrollo.orderBy("bloque").limit(2).collect()]
    names = ["bloque", "Semanas adicionales", "peso forza proyectado"]
    given = spark.createDataFrame(
        [(blocks[0], 0, 2000.0), (blocks[0], 4, 2600.0), (blocks[1], 2, None), ("none", 1, 1.0)],
        "bloque string, `Semanas adicionales` int, `peso forza proyectado` double",
    ).select(*names)
    got = forcing.forcing_scenarios(tables, AS_OF, PLANTED_SINCE, scenarios=given)
    days = {
        (r.llave, r["Semanas adicionales"]): ((r.finduccion - AS_OF).days, r.peso_forza)
        for r in got.collect()
    }
    assert days == {
        (blocks[0], 0): (0, 2.0), (blocks[0], 4): (29, 2.6), (blocks[1], 2): (15, None),
    }
    one = forcing.forcing_scenarios(tables, AS_OF, PLANTED_SINCE, blocks[:1], given)
    assert one.count() == 2
    whole = forcing.forcing_scenarios(tables, AS_OF, PLANTED_SINCE)
    assert sorted(whole.columns) == sorted(got.columns)
    wrong = given.limit(1).withColumn("Semanas adicionales", F.lit(9))
    with pytest.raises(PySparkException, match="0 to 4"):
        forcing.forcing_scenarios(tables, AS_OF, PLANTED_SINCE, scenarios=wrong).collect()


@pytest.fixture(scope="module")
def models(tables):
    return forecast.fit_models(tables)


def test_models_beat_the_mean_and_the_linear_one_its_normal_equations(tables, models):
    """The linear model against least squares in numpy, both against the mean of the labels."""
    import numpy as np

    rows = forecast.training_rows(tables)
    for crop, model, column, inputs in (
        ("PC", models[0], "_pc", forecast.FIRST_CROP_INPUTS),
        ("SC", models[1], "_sc", forecast.SECOND_CROP_INPUTS),
    ):
        frame = model.transform(rows.where(F.col("desarrollo") == crop)).toPandas()
        y = frame[forecast.LABEL].to_numpy()
        error = np.mean((frame[column] - y) ** 2)
        assert np.var(y) > 0 and error < 0.3 * np.var(y)
        if crop == "PC":
            x = frame[inputs].astype(float)
            x = x.fillna(x.mean()).to_numpy()
            x = np.column_stack([np.ones(len(x)), x])
            best = x @ np.linalg.lstsq(x, y, rcond=None)[0]
            # The penalty of the fitted model costs little beside plain least squares.
            assert np.mean((best - y) ** 2) <= error < np.mean((best - y) ** 2) + 0.05 * np.var(y)


def test_forecast_scores_both_crops(tables, models):
    got = forecast.harvest_forecast(tables, AS_OF, PLANTED_SINCE, models=models)
    scenarios = forcing.forcing_scenarios(tables, AS_OF, PLANTED_SINCE)
    assert got.count() == scenarios.count()
    counts = {r.desarrollo: r["count"] for r in got.groupBy("desarrollo").count().collect()}
    assert set(counts) == {"PC", "SC"}
    assert got.where("prediccion is null or `kilos proyectados` is null").count() == 0


def test_stored_models_score_alike(tables, models, tmp_path):
    forecast.write_models(models, str(tmp_path / "models"))
    stored = forecast.read_models(str(tmp_path / "models"))
    same(
        forecast.harvest_forecast(tables, AS_OF, PLANTED_SINCE, models=stored),
        forecast.harvest_forecast(tables, AS_OF, PLANTED_SINCE, models=models),
    )


def test_linear_projection_of_missing_inputs(spark):
    df = spark.createDataFrame([(2.0, 10.0), (None, 10.0)], "x double, area double")
    got = forecast.linear_projection(df, {"x": 3.0}, 1.0).collect()
    assert [(r.prediccion, r["kilos proyectados"]) for r in got] == [(7.0, 70.0), (1.0, 10.0)]


def _sorted_by(values, falling: bool, nulls_first: bool) -> list:
    blank, rest = [v for v in values if v is None], sorted((v for v in values if v is not None), reverse=falling)
    return blank + rest if nulls_first else rest + blank


@pytest.mark.parametrize(
    ("name", "column", "falling", "nulls_first"),
    [
        ("group_list", "fecha", False, False),
        ("lot_list", "label", False, False),
        ("formula_list", "label", False, False),
        ("forcing_candidates", "edad actual meses", True, True),
        ("forcing_table", "edad actual meses", True, True),
        ("alert_preforza_list", "dias_desde_ultima_aplicacion", True, False),
        ("alert_postforza_list", "dias_desde_ultima_aplicacion", True, False),
        ("alert_semillero_list", "dias_desde_ultima_aplicacion", True, False),
        ("alert_new_blocks_list", "dias_sin_aplicacion", True, False),
    ],
)
def test_order_of_report(spark, sf_dir, name, column, falling, nulls_first):
    values = [r[column] for r in QUERIES[name](spark, sf_dir).collect()]
    assert values and values == _sorted_by(values, falling, nulls_first)


def test_order_of_one_page_of_a_group(tables):
    """A page is sorted by date; the listing of all groups is left as it is stored."""
    page = tables.aplicaciones.groupBy("grupo", "etapa2", "categoria").agg(F.countDistinct("fecha").alias("n"))
    page = page.where("grupo is not null").orderBy(F.desc("n"), "grupo", "etapa2", "categoria").first()
    rows = group_detail.group_applications(tables, page.grupo, page.etapa2, page.categoria).collect()
    values = [r["fecha aplicación"] for r in rows]
    assert len(set(values)) > 1 and values == _sorted_by(values, False, False)


def test_blank_dates_come_before_the_latest(spark):
    rows = [("F 2", None, "x"), ("F 1", "2021-01-02", "x"), ("F 1", None, "x"), ("F 3", "2021-03-01", None), (None, None, "x")]
    df = spark.createDataFrame(rows, "codigo_formula string, fecha string, grupo string")
    got = df.withColumn("descripcion_formula", F.lit("f")).orderBy(*alerts._latest()).collect()
    assert [(r.codigo_formula, r.fecha) for r in got] == [
        ("F 1", None), ("F 2", None), (None, None), ("F 3", "2021-03-01"), ("F 1", "2021-01-02"),
    ]
