"""The store in buckets by block, and the sums and sketches by day."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldspark.plans import weights
from fieldspark.sources import blockstore, daystate
from fieldspark.sources.blockstore import BlockStore, write_block_store
from fieldspark.sources.tables import frame_tables
from verification.queries import QUERIES

NAMES = ("pesoplanta", "blocks_desarrollo")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def test_reports_of_blocks_move_nothing(spark, tables, tmp_path, no_broadcast):
    write_block_store(tables, f"file://{tmp_path}/s", 8, NAMES)
    store = BlockStore(spark, f"file://{tmp_path}/s", 8, NAMES)
    rest, apart = store.parts()
    report = weights.last_weight_before_induction(rest)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and re.search(r"Bucketed: true", plan)
    assert apart.pesoplanta.isEmpty()
    assert rows(store.by_block(weights.last_weight_before_induction)) == rows(weights.last_weight_before_induction(tables))
    store.close()


def test_a_heavy_block_is_kept_apart(spark, tables, tmp_path):
    """A block with half of all samples is in no bucket, and no row is lost."""
    samples = tables.pesoplanta
    hot = samples.groupBy("llave").count().orderBy(F.desc("count"), "llave").first().llave
    more = samples.withColumn("llave", F.when(F.hash("fecha", "valor") % 2 == 0, hot).otherwise(F.col("llave")))
    more = more.unionByName(samples.limit(3).withColumn("llave", F.lit(None).cast("string")))
    both = frame_tables({"pesoplanta": more, "blocks_desarrollo": tables.blocks_desarrollo})
    root = f"file://{tmp_path}/s"
    write_block_store(both, root, 8, NAMES)
    assert [r.bloque for r in spark.read.parquet(f"{root}/_apart").collect()] == [hot]
    store = BlockStore(spark, root, 8, NAMES)
    rest, apart = store.parts()
    assert rest.pesoplanta.where(F.col("llave") == hot).isEmpty() and not apart.pesoplanta.isEmpty()
    assert rest.pesoplanta.count() + apart.pesoplanta.count() == more.count()
    want = weights.last_weight_before_induction(both)
    assert rows(store.by_block(weights.last_weight_before_induction)) == rows(want)
    store.close()


def test_heavy_blocks_are_few(tables):
    assert blockstore.heavy_blocks(tables, NAMES, 10**6, 2.0).count() > 0
    assert blockstore.heavy_blocks(tables, NAMES, 4, 2.0).count() == 0


SAMPLES = "llave string, fecha date, valor decimal(12,2)"


def day(k):
    return dt.date(2001, 1, 1) + dt.timedelta(days=k) if k is not None else None


def test_late_repeated_and_corrected_days(spark, tmp_path):
    data = [(f"b{k % 4}", day(k % 70), Decimal(k)) for k in range(700)]
    data += [("b1", None, Decimal(5)), (None, day(3), Decimal(7))]
    whole = spark.createDataFrame(data, SAMPLES)
    state = daystate.weight_state(f"file://{tmp_path}/w")
    assert state.read(spark).count() == 0 and state.between(spark, day(0), day(9)).count() == 0
    part = lambda p: spark.createDataFrame([r for r in data if p(r[1])], SAMPLES)
    state.update(part(lambda d: d is not None and d > day(40)))
    wrong = [(b, d, Decimal(99)) for b, d in (("b0", day(5)), ("b9", day(5)), ("b9", None))]
    state.update(spark.createDataFrame(wrong, SAMPLES))
    state.update(part(lambda d: d is None or d <= day(40)))  # late days; day 5 and the undated ones corrected
    files = sorted(tmp_path.rglob("*.parquet"))
    state.update(part(lambda d: d == day(60)))  # again
    changed = {p.parent.name for p in set(tmp_path.rglob("*.parquet")) ^ set(files)}
    assert changed == {"_mes=2001-03-01"}
    want = whole.groupBy("fecha", "llave").agg(F.sum("valor").cast("decimal(38,2)").alias("suma"), F.count("valor").alias("n"))
    assert rows(state.read(spark)) == rows(want)
    report = weights.latest_weight(frame_tables({"pesoplanta": whole}))
    assert rows(daystate.latest_weight(spark, state)) == rows(report)
    between = whole.where(F.col("fecha").between(day(10), day(45))).groupBy("llave")
    want = between.agg(F.sum("valor").cast("decimal(38,2)").alias("suma"), F.count("valor").alias("n"))
    assert rows(state.between(spark, day(10), day(45))) == rows(want)
    plan = state.between(spark, day(10), day(45))._jdf.queryExecution().executedPlan().toString()
    assert "_mes" in re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)


def test_merged_sketches_are_near_the_exact_ranks(spark, tmp_path):
    """Many samples over many days: counts and ends are exact, ranks within the bound."""
    rows_ = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("b"), F.col("id") % 400)).alias("llave"),
        F.date_add(F.lit(day(0)), (F.col("id") % 90).cast("int")).alias("fecha"),
        (F.pmod(F.col("id") * 7919, F.lit(100_003)) / 100).cast("decimal(12,2)").alias("valor"),
    )
    state = daystate.weight_sketches(f"file://{tmp_path}/q")
    state.update(rows_.where(F.col("fecha") > day(50)))
    state.update(rows_.where(F.col("fecha") <= day(50)))
    first, last = day(10), day(75)
    got = {r.llave: r for r in daystate.weight_quantiles(spark, state, first, last).collect()}
    values = {}
    for r in rows_.where(F.col("fecha").between(first, last)).collect():
        values.setdefault(r.llave, []).append(float(r.valor))
    assert got.keys() == values.keys()
    off = []
    for block, found in values.items():
        found.sort()
        r = got[block]
        assert (r.muestras, r.minimo, r.maximo) == (len(found), found[0], found[-1])
        for p, q in ((0.25, r.q1), (0.5, r.mediana), (0.75, r.q3)):
            low, high = sum(v < q for v in found), sum(v <= q for v in found)
            off.append(max(0.0, low / len(found) - p, p - high / len(found)))
    assert sum(x > 0.017 for x in off) <= 0.02 * len(off) and max(off) < 0.04
    assert state.read(spark).where("llave = 'big'").selectExpr("max(length(dibujo))").first()[0] < 8000


def test_buckets_grow_with_the_rows(spark, tables, sf_dir, monkeypatch):
    """A task sorts and groups one bucket, so a larger table has more of them, not larger ones."""
    used, write = [], blockstore.write_block_store
    monkeypatch.setattr(blockstore, "write_block_store", lambda t, root, buckets, names: used.append(buckets) or write(t, root, buckets, names))
    expected = sorted(map(tuple, QUERIES["last_weight_co_located"](spark, sf_dir).collect()))
    monkeypatch.setattr(blockstore, "BUCKET_ROWS", 300)
    rows = tables.pesoplanta.count()
    assert sorted(map(tuple, QUERIES["last_weight_co_located"](spark, sf_dir).collect())) == expected != []
    assert used == [16, -(-rows // 300)] and used[1] > 16
