import datetime as dt
import re
import tempfile

import pytest

from fieldspark.functions.dates import week_ranges, year_ranges
from fieldspark.plans import alerts, groups, status
from fieldspark.sources.fixture import AS_OF
from fieldspark.sources.jdbc import scan_options
from fieldspark.sources.store import export_table, write_tables
from fieldspark.sources.tables import conform, frame_tables, parquet_tables
from verification.compare import rows_of, spark_frame


@pytest.fixture(scope="module")
def store(spark, tables):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    write_tables(tables, root)
    return parquet_tables(spark, root)


def test_store_returns_the_same_tables(store, tables):
    for name in ("aplicaciones", "pesoplanta", "blocks", "historia_bloques"):
        got, want = getattr(store, name), getattr(tables, name)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert rows_of(spark_frame(got)) == rows_of(spark_frame(want))


def test_store_reads_only_the_wanted_year(store, tables, final_plan):
    rows = store.dated("aplicaciones", year_ranges(1999))
    assert rows.count() == tables.aplicaciones.where("year(fecha) = 1999").count()
    plan = final_plan(rows)
    assert "PartitionFilters: [isnotnull(anio" in plan
    assert "GreaterThanOrEqual(fecha,1999-01-01)" in plan
    week = store.dated("aplicaciones", week_ranges(1999, 52))
    want = tables.aplicaciones.where("year(fecha) = 1999 and weekofyear(fecha) = 52")
    assert week.count() == want.count()


def test_alerts_read_recent_partitions_only(store, tables, final_plan):
    listed = alerts.alert_preforza_list(store, AS_OF)
    plan = final_plan(listed)
    scan = next(line for line in plan.splitlines() if "/aplicaciones" in line)
    assert "Or(GreaterThanOrEqual(fecha,2001-09-22),IsNull(fecha))" in scan
    assert re.search(r"PartitionFilters: \[.*anio.* >= 2001.* OR isnull\(anio", scan)
    want = alerts.alert_preforza_list(tables, AS_OF)
    assert rows_of(spark_frame(listed)) == rows_of(spark_frame(want))


def test_open_range_and_null_dates(spark, tables):
    rows = [("a", dt.date(2019, 12, 31)), ("b", dt.date(2020, 1, 1)), ("c", None)]
    schema = "llave string, fecha date"
    frame = spark.createDataFrame(rows, schema).selectExpr(
        "*", "cast(1 as decimal(12,2)) as valor", "year(fecha) as anio"
    )
    t = frame_tables({"pesoplanta": frame})
    since = [(dt.date(2020, 1, 1), None)]
    assert [r.llave for r in t.dated("pesoplanta", since).collect()] == ["b"]
    assert [r.llave for r in t.dated("pesoplanta", since, keep_null=True).collect()] == ["b", "c"]
    assert t.dated("pesoplanta", None).count() == 3


def test_reports_agree_over_store_and_source(store, tables):
    for report in (groups.group_quality, groups.monthly_quality_share):
        assert rows_of(spark_frame(report(store))) == rows_of(spark_frame(report(tables)))


def test_schema_faults_are_errors(spark):
    frame = spark.createDataFrame([("1", 2.0)], "codigo string, area double")
    with pytest.raises(ValueError, match="lote is missing"):
        conform(frame, "blocks")
    frame = spark.createDataFrame([(1, "L", 2.0)], "codigo int, lote string, area double")
    with pytest.raises(ValueError, match="codigo is int, expected string"):
        conform(frame, "blocks")
    with pytest.raises(AttributeError):
        frame_tables({}).unknown_table


def test_lossless_types_are_taken(spark):
    frame = spark.sql(
        "select 'a' as llave, timestamp_ntz '2020-05-01 10:00:00' as fecha, "
        "cast(3 as decimal(20,5)) as valor, 'x' as extra"
    )
    got = conform(frame, "pesoplanta")
    assert got.schema.simpleString() == "struct<llave:string,fecha:date,valor:decimal(20,5)>"
    assert got.first().fecha == dt.date(2020, 5, 1)


def test_range_on_a_stored_timestamp_reaches_the_scan(tables, final_plan):
    plan = final_plan(tables.dated("aplicaciones", year_ranges(1999)))
    assert "GreaterThanOrEqual(l_shipdate,1999-01-01T00:00)" in plan
    assert "LessThan(l_shipdate,2000-01-01T00:00)" in plan


def test_export_has_no_markup(spark, tables):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/estado"
    rows = status.lot_block_status(tables)
    export_table(rows, path)
    got = spark.read.csv(path, header=True)
    assert got.columns == rows.columns
    assert got.count() == rows.count()
    assert got.where("`grupo de siembra` like '%](%'").count() == 0
    export_table(rows, path + "_p", "parquet")
    assert spark.read.parquet(path + "_p").count() == rows.count()


def test_jdbc_scan_options():
    bounds = {"since": dt.date(2014, 1, 1), "until": dt.date(2022, 1, 1)}
    options = scan_options("aplicaciones", "jdbc:postgresql://db/farm", **bounds, partitions=32)
    assert options["partitionColumn"] == "fecha"
    assert options["numPartitions"] == "32"
    assert options["lowerBound"] == "2014-01-01"
    assert "partitionColumn" not in scan_options("blocks", "jdbc:postgresql://db/farm", **bounds)
