"""What the physical plans must and must not contain."""

import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from fieldspark.plans import alerts, groups, program, weights
from fieldspark.sources.fixture import AS_OF
from fieldspark.sources.tables import frame_tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_treatment_is_limited_before_the_shuffle(tables):
    plan = plan_of(alerts.alert_preforza(tables, AS_OF))
    assert re.search(r"WindowGroupLimit.*Partial", plan)
    plan = plan_of(weights.latest_weight(tables))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_filters_reach_the_scan(tables):
    plan = plan_of(groups.monthly_quality_share(tables, "preforza", "nutricion", 1999))
    assert "GreaterThanOrEqual(l_shipdate,1999-01-01T00:00)" in plan
    plan = plan_of(program.weekly_program(tables, 1999, 20))
    assert "GreaterThanOrEqual(l_shipdate,1999-05-17T00:00)" in plan
    assert "LessThan(l_shipdate,1999-05-24T00:00)" in plan


def test_scans_read_only_needed_columns(tables):
    plan = plan_of(weights.weights_by_day(tables))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "l_orderkey" not in schema and "l_returnflag" not in schema


def test_charts_move_counts_only(tables, final_plan):
    """Treatments are counted before they meet the blocks, and each table is read once."""
    plan = final_plan(groups.monthly_quality_by_group(tables))
    assert plan.index("Join") < plan.index("partial_count(1)")
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem", plan)) == 2  # done, and pending


def test_not_in_reads_its_subquery_once(tables, final_plan):
    plan = final_plan(alerts.alert_new_blocks(tables, AS_OF))
    scans = len(re.findall(r"FileScan parquet[^\n]*lineitem", plan))
    assert scans == 1 or "ReusedExchange" in plan


def test_treatments_are_counted_before_the_join(tables):
    plan = plan_of(groups.monthly_quality_area_by_lot(tables))
    assert plan.index("Join") < plan.index("partial_count(1)")


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
SMALL_SKEW = {
    **NO_BROADCAST,
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_hot_block(df, column, copies):
    """`copies` times the rows, a third of them moved to one block."""
    many = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    hot = F.when(F.pmod(F.xxhash64(*many.columns), F.lit(3)) == 0, "0700007")
    # Spark splits a hot partition by the tasks that wrote it, so there must be several.
    return many.withColumn(column, F.coalesce(hot, F.col(column))).repartition(8)


def test_anti_join_is_an_ordinary_join(spark, tables):
    """NOT IN must not fall back to shipping the subquery to every executor."""
    with settings(spark, NO_BROADCAST):
        plan = plan_of(alerts.alert_new_blocks(tables, AS_OF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_hot_block_is_split_by_the_row_level_join(spark, tables, final_plan):
    rows = with_hot_block(tables.aplicaciones, "blocknumber", 40).drop("_copy")
    t = frame_tables({"aplicaciones": rows, "blocks": tables.blocks})
    with settings(spark, SMALL_SKEW):
        joined = groups.monthly_quality_rows(t)
        assert "skew=true" in final_plan(joined)
        assert joined.count() == rows.count()


def test_hot_block_in_the_programme(spark, tables):
    """The plan of a block is counted before it meets the groups; no entry is lost."""
    rows = with_hot_block(tables.programacionaplicaciones, "block", 40).withColumn(
        "area", F.col("area") + F.col("_copy")
    )
    plan = rows.drop("_copy")
    t = frame_tables(
        {"programacionaplicaciones": plan, "historia_bloques": tables.historia_bloques}
    )
    listed = program.weekly_program_rows(t)
    text = plan_of(listed)
    assert text.index("Join") < text.index("partial_count(1)")
    want = plan.distinct().agg(F.sum("area"), F.count("*")).first()
    area = program.weekly_program_area(t).select(F.sum("area"), F.sum("entradas")).first()
    assert (float(area[0]), area[1]) == (want[0], want[1])
    assert listed.select(F.sum("veces")).first()[0] == plan.distinct().where("block is not null").count()
