import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators.frames import fill_blank, first_per_key, round_numbers
from fieldspark.operators.joins import in_keys, not_in
from fieldspark.operators.lists import cell_text, entries, totals
from fieldspark.operators.quantiles import distribution


@pytest.mark.parametrize(
    "left,right",
    [
        (["a", "b", None], ["b", "c"]),
        (["a", "b", None], ["b", None]),
        (["a", "b", None], []),
        (["a", "b", None], [None]),
        ([], ["a"]),
        (["a", "a", None, "c"], ["x", "y", "y"]),
    ],
)
def test_not_in_has_the_null_rules_of_sql(spark, left, right):
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(left)], "k string, i int")
    other = spark.createDataFrame([(x,) for x in right], "o string")
    got = sorted(r.i for r in not_in(rows, "k", other, "o").collect())
    rows.createOrReplaceTempView("not_in_rows")
    other.createOrReplaceTempView("not_in_other")
    sql = "select i from not_in_rows where k not in (select o from not_in_other)"
    assert got == sorted(r.i for r in spark.sql(sql).collect())


def test_not_in_on_random_lists(spark):
    rng = random.Random(5)
    for _ in range(8):
        pool = [None, *"abcd"] if rng.random() < 0.5 else list("abcd")
        left = [(rng.choice([None, *"abcdef"]), i) for i in range(rng.randrange(8))]
        right = [(rng.choice(pool),) for _ in range(rng.randrange(4))]
        rows = spark.createDataFrame(left, "k string, i int")
        other = spark.createDataFrame(right, "o string")
        got = sorted(r.i for r in not_in(rows, "k", other, "o").collect())
        keys = [o for (o,) in right]
        if not keys:
            want = [i for _, i in left]
        elif None in keys:
            want = []
        else:
            want = [i for k, i in left if k is not None and k not in keys]
        assert got == sorted(want)


def test_in_keys_keeps_each_row_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, i int")
    other = spark.createDataFrame([("a",), ("a",), (None,)], "o string")
    assert sorted(r.i for r in in_keys(rows, "k", other, "o").collect()) == [1, 2]


def test_first_per_key_puts_missing_dates_first(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("b", None, "z"), ("b", 9, "w")], "k string, n int, v string"
    )
    got = first_per_key(rows, ["k"], [F.col("n").desc_nulls_first()]).collect()
    assert sorted((r.k, r.v) for r in got) == [("a", "y"), ("b", "z")]


def test_entries_have_one_shape_at_every_size(spark):
    rng = random.Random(7)
    rows = [("hot", f"{i:05d}") for i in range(3000)]  # a third and more of all rows
    rows += [("same", "x")] * 1500  # one item repeated
    rows += [(f"k{i % 900}", f"{rng.randrange(40):02d}") for i in range(4000)]
    rows += [("null", None), ("null", None), (None, "n"), ("mixed", None), ("mixed", "m")]
    df = spark.createDataFrame(rows, "k string, v string").repartition(8)
    want = Counter(rows)
    got = entries(df, ["k"], "v", "entrada").collect()
    assert {(r.k, r.entrada): r.veces for r in got} == {x: n if x[1] is not None else 0 for x, n in want.items()}
    assert len(got) == len(want)


def test_totals_are_one_row_per_key(spark):
    rows = [("hot", f"{i}", 2, 1.5) for i in range(2000)] + [("a", "x", 1, 4.0), ("b", None, 3, None)]
    df = spark.createDataFrame(rows, "k string, v string, n int, m double")
    got = totals(df, ["k"], ["m"], "n").collect()
    assert {(r.k, r.m, r.entradas) for r in got} == {("hot", 3000.0, 4000), ("a", 4.0, 1), ("b", None, 3)}
    assert len(got) == 3


def test_cell_text(spark):
    rows = [("a", "x", 3), ("a", "x", 2), ("a", "y", 1), ("a", None, 4), ("b", None, 1)]
    df = spark.createDataFrame(rows, "k string, v string, n bigint")
    counted = entries(df, ["k"], "v", "entrada", times="n")
    got = {r.k: r.lista for r in cell_text(counted, ["k"], "entrada", ",", "lista").collect()}
    assert got == {"a": "x,x,x,x,x,y", "b": None}


def test_distribution_of_a_hot_key_equals_numpy(spark):
    rng = random.Random(11)
    rows = [("hot", rng.randrange(100_000)) for _ in range(4000)]
    rows += [(f"k{i % 50}", rng.randrange(5000)) for i in range(400)]
    rows += [(None, 300), (None, 100), ("one", 7), ("gap", None), ("neg", -250), ("neg", 50)]
    df = spark.createDataFrame(rows, "k string, c int").select(
        "k", (F.col("c") / 100).cast("decimal(12,2)").alias("v")
    )
    got = distribution(df, ["k"], "v", {"q1": 0.25, "mediana": 0.5, "q3": 0.75}, band_width=10)
    by_key = defaultdict(list)
    for k, c in rows:
        if c is not None:
            by_key[k].append(c / 100)
    found = {r.k: r for r in got.collect()}
    assert set(found) == set(by_key)
    for k, values in by_key.items():
        r = found[k]
        assert r.muestras == len(values)
        want = [min(values), *np.percentile(values, [25, 50, 75]), max(values), np.mean(values)]
        assert [r.minimo, r.q1, r.mediana, r.q3, r.maximo, r.promedio] == pytest.approx(want)


def test_distribution_counts_once(spark, final_plan, tables):
    from fieldspark.plans.weights import weight_distribution

    assert "ReusedExchange" in final_plan(weight_distribution(tables))


def test_blank_and_round(spark):
    df = spark.createDataFrame([(None, 1.005, 2), ("x", None, None)], "a string, `b c` double, d int")
    assert [tuple(r) for r in fill_blank(df).collect()] == [("", "1.005", "2"), ("x", "", "")]
    assert [tuple(r) for r in round_numbers(df).collect()] == [(None, 1.01, 2), ("x", None, None)]


def test_costly_expressions_over_a_small_file_are_spread(spark, sf_dir):
    from verification.queries import QUERIES

    cells = QUERIES["markup_cells"](spark, sf_dir)
    assert cells.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
