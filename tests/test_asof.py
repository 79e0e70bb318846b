"""As-of join against a scan of all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import asof
from fieldspark.operators.asof import asof_join

LEFT, RIGHT = "k string, at timestamp, v int", "k string, day timestamp, w int, x string"


def rows(rng, n, keys, times):
    return [(rng.choice(keys), None if rng.random() < 0.02 else rng.choice(times), i) for i in range(n)]


def brute(left, right, strict):
    out = []
    for k, at, v in left:
        best = None
        for k2, day, w, x in right:
            if k is not None and k == k2 and at and day and (day < at or (day == at and not strict)):
                best = max(best or (day, (w, x)), (day, (w, x)))
        out.append((k, at, v, *(best[1] if best else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("span", ["month", "hour"])
def test_equals_a_scan_of_all_pairs(spark, strict, span):
    rng = random.Random(4)
    times = [dt.datetime(2001, 1, 1) + dt.timedelta(hours=rng.randrange(5000)) for _ in range(60)]
    left = rows(rng, 300, ["a", "b", "c", None], times)
    right = [(k, t, rng.randrange(9), rng.choice("pq")) for k, t, _ in rows(rng, 90, ["a", "b", "d", None], times)]
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "at", "day", ["w", "x"], strict, span)
    assert got.columns == ["k", "at", "v", "w", "x"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, right, strict)


def test_empty_sides_and_clashing_names(spark):
    left, right = spark.createDataFrame([("a", dt.datetime(2001, 1, 1), 1)], LEFT), spark.createDataFrame([], RIGHT)
    (row,) = asof_join(left, right, ["k"], "at", "day", ["w"]).collect()
    assert tuple(row) == ("a", dt.datetime(2001, 1, 1), 1, None)
    assert asof_join(left.where("false"), right, ["k"], "at", "day", ["w"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right.withColumn("v", F.lit(1)), ["k"], "at", "day", ["v"])


def test_no_task_has_all_times_of_a_block(spark, monkeypatch):
    """One key with half of all rows: its times spread over the tasks, its rows are reduced before."""
    start = dt.datetime(2001, 1, 1)
    left = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.timestamp_seconds(F.lit(int(start.timestamp())) + (F.col("id") % 40_000) * 1800).alias("at"),
        F.col("id").cast("int").alias("v"),
    )
    right = left.where("v % 7 = 0").select("k", F.col("at").alias("day"), F.col("v").alias("w"), F.lit("x").alias("x"))
    seen = []
    within = asof.last_within_span
    monkeypatch.setattr(asof, "last_within_span", lambda both, on: seen.append(within(both, on)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = asof_join(left, right, ["k"], "at", "day", ["w"])
        per_task = seen[0].groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("_carried"))
        tasks = [r.n for r in per_task.collect()]
        assert len(tasks) == 16 and max(tasks) < 0.2 * sum(tasks)
        assert got.count() == 60_000 and got.where("w is not null").count() > 59_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
