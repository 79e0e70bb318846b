"""Tasks that group rows: their number grows with the rows, so that none needs more memory on a larger table."""

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import frames
from fieldspark.plans import program, weights
from fieldspark.sources.tables import Tables
from verification.queries import ON_TABLES as QUERIES_ON_TABLES


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_rows_are_dealt_by_keys(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    many = spark.range(1_000).select((F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    assert frames.dealt(many, "k").rdd.getNumPartitions() == 10
    assert frames.dealt(many, "k", rows=250).rdd.getNumPartitions() == 3
    few = many.limit(100)
    assert frames.dealt(few, "k") is few
    counted = frames.dealt(many, "k").groupBy("k", "v").count()
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert counted.count() == 1_000


@pytest.mark.parametrize("report", [program.weekly_program, program.weekly_program_rows, program.weekly_program_area])
def test_the_programme_in_many_tasks(tables, monkeypatch, report):
    before = rows(report(tables))
    monkeypatch.setattr(frames, "TASK_ROWS", 200)
    assert rows(report(tables)) == before
    if report is not program.weekly_program_area:  # its totals are few rows, in one more exchange
        assert most_in_a_task(report(tables)) < 2 * 200


def test_samples_are_dealt_by_block_and_day(tables, monkeypatch):
    reports = weights.daily_weights, weights.weight_before_treatment, weights.latest_weight
    before = [rows(report(tables)) for report in reports]
    monkeypatch.setattr(frames, "TASK_ROWS", 300)
    assert [rows(report(tables)) for report in reports] == before
    assert most_in_a_task(weights.daily_weights(tables)) < 2 * 300
    latest = weights.latest_weight(tables)
    assert "REPARTITION_BY_NUM" in latest._jdf.queryExecution().executedPlan().toString()
    plan = weights.weight_before_treatment(tables)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(llave" in plan and "hashpartitioning(bloque" in plan and plan.count("REPARTITION_BY_NUM") >= 2


def test_buckets_of_blocks_stay_where_they_are(tables, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 300)
    bucketed = Tables(lambda name: getattr(tables, name), co_located=True)
    plan = weights.daily_weights(bucketed)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan


@pytest.mark.parametrize("name", ["forcing_scenarios_edited", "forcing_scenarios", "model_base", "forcing_candidates", "last_weight_before_induction"])
def test_long_sides_of_joins_are_not_broadcast(tables, monkeypatch, name):
    report = QUERIES_ON_TABLES[name]
    before = rows(report(tables))
    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    after = report(tables)
    assert "BroadcastHashJoin" not in after._jdf.queryExecution().executedPlan().toString()
    assert rows(after) == before
