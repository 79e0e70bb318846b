"""Reports as SQL text against the same reports as functions."""

import re

import pytest
from pyspark.sql import functions as F

from fieldspark.plans import alerts, group_detail, program, statements, status, weights
from fieldspark.plans.statements import register, statement
from fieldspark.sources.fixture import AS_OF
from fieldspark.sources.tables import frame_tables


@pytest.fixture(scope="module")
def known(spark, tables):
    register(spark, tables, "t_")
    return lambda name, **arguments: statement(spark, name, "t_", **arguments)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_statements_equal_functions(tables, known):
    block = tables.pesoplanta.orderBy("llave").first().llave
    code = tables.formulas_det.first().codigo
    assert rows(known("pesos", de_bloque=block)) == rows(weights.weight_samples(tables, block)) != []
    assert rows(known("ultimo_muestreo")) == rows(weights.latest_weight(tables))
    assert rows(known("insumos_formula", de_codigo=code)) == rows(status.formula_inputs(tables, code)) != []
    assert rows(known("insumos_formula")) == rows(status.formula_inputs(tables))
    assert rows(known("bloques_nuevos", hoy=AS_OF)) == rows(alerts.alert_new_blocks(tables, AS_OF)) != []
    assert rows(known("programa_semanal", anio=1999, semana=20)) == rows(program.weekly_program_area(tables, 1999, 20)) != []
    group = tables.calidad_aplicaciones.where("grupo is not null").first().grupo
    mine = known("calidad_grupo", de_grupo=group, de_categoria="nutricion").select("pendientes", "realizadas", "tardias", "adelantadas")
    theirs = group_detail.group_block_quality(tables, group, "nutricion")
    assert rows(mine) == rows(theirs.select(*[F.col(f"`{c}`") for c in theirs.columns if c.startswith("#")])) != []


def test_arguments_are_values(known):
    assert known("pesos", de_bloque="x' or '1' = '1").isEmpty()
    with pytest.raises(ValueError):
        known("pesos", bloque="x")
    with pytest.raises(ValueError):
        known("pesos; drop table t_pesoplanta")


def test_bound_dates_reach_the_scan(known):
    plan = known("programa_semanal", anio=1999, semana=20)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"GreaterThanOrEqual\(l_shipdate,1999-01-01", plan)
    assert "Python" not in plan and "NestedLoop" not in plan


def test_new_blocks_has_the_null_rules_of_not_in(spark, tables):
    some = tables.blocks_desarrollo.limit(6).withColumn("finduccion", F.lit(None).cast("date"))
    some = some.unionByName(some.limit(1).withColumn("bloque", F.lit(None).cast("string")))
    done = tables.aplicaciones.limit(20)
    for treatments in (done, done.where("false"), done.unionByName(done.limit(1).withColumn("bloque", F.lit(None).cast("string")))):
        t = frame_tables({**{n: getattr(tables, n) for s in statements.STATEMENTS.values() for n in s.tables}, "blocks_desarrollo": some, "aplicaciones": treatments})
        register(spark, t, "n_")
        assert rows(statement(spark, "bloques_nuevos", "n_", hoy=AS_OF)) == rows(alerts.alert_new_blocks(t, AS_OF))
