"""Markup, export files, splits of undated tables, and the counts of odd crops."""

import csv
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldspark.functions.markup import markup_text
from fieldspark.plans.forecast import counted_crops
from fieldspark.sources.splits import boundaries, split_conditions
from fieldspark.sources.store import export_files, read_export

CELLS = {
    "plain": "plain",
    "": "",
    "**bold** and *it*": "bold and it",
    "snake_case_name": "snake_case_name",
    "_em_ x": "em x",
    "_a __b__ c_": "a b c",
    "***x***": "x",
    "**a*": "*a",
    "2 * 3 * 4": "2 * 3 * 4",
    "a*b*c": "abc",
    "(*a*)": "(a)",
    "** a": "** a",
    "línea\n*dos*": "línea\ndos",
    "[a](b)": "a",
    "[x_y](a_b) z": "x_y z",
    "[grupo_1](/d?g=grupo_1)": "grupo_1",
    "[a *b*](c(d)e) f": "a b f",
    "[****](x)": "****",
    "[x] y": "[x] y",
    "[o [i](t) x](u)": "[o i x](u)",
    "*a [b*](c)": "*a b*",
    "![img](x) t": " t",
    "[![i](x) lab](y)": " lab",
    "x ! [l](t)!": "x ! l!",
    "`a*b*` c": "a*b* c",
    "`` a`b `` c": "a`b c",
    "a `b": "a `b",
    r"\*no\* \[x\](y)": "*no* [x](y)",
    "\\a": "\\a",
    "!": "!",
}


def test_markup(spark):
    df = spark.createDataFrame([(k,) for k in CELLS] + [(None,)], "t string")
    got = {r.t: r.g for r in df.select("t", markup_text(F.col("t")).alias("g")).collect()}
    assert got == {**CELLS, None: None}


def test_export_files_are_bounded_and_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(500) if k % 9 else None, f"[b{k}](x)") for k in range(5000)]
    df = spark.createDataFrame(rows, "n int, t string").repartition(7)
    order = [F.col("n").asc_nulls_last(), F.col("t")]
    export_files(df, str(tmp_path / "c"), order, 300)
    found = []
    for path in sorted((tmp_path / "c").glob("*.csv")):
        with path.open(encoding="utf-8") as f:
            lines = list(csv.DictReader(f))
        assert 0 < len(lines) <= 300
        found += [(int(x["n"]) if x["n"] else None, x["t"]) for x in lines]
    want = sorted(((n, t[1 : t.index("]")]) for n, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert found == want
    export_files(df, str(tmp_path / "p"), order, 300, "parquet")
    back = sorted((r.orden, r.n, r.t) for r in read_export(spark, str(tmp_path / "p")).collect())
    assert [r[0] for r in back] == list(range(5000)) and [r[1:] for r in back] == want


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(9,2)"])
@pytest.mark.parametrize("sample", [10_000, 40])
def test_every_row_satisfies_one_condition(spark, kind, sample):
    rng = random.Random(7)
    keys = [rng.choice([500, rng.randrange(900), rng.randrange(900)]) for _ in range(3000)]
    text = {"string": "concat('bl''o', k)", "date": "date_add(date'2001-01-01', k)"}.get(kind, f"cast(k as {kind})")
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)] * 50, "k int").selectExpr(f"{text} as k").repartition(4)
    conditions = split_conditions(df, "k", 8, sample, quote="`", collate=None)
    assert 6 <= len(conditions) <= 14
    sizes = [df.where(c).count() for c in conditions]
    assert sum(sizes) == 3050  # each row once: the sum, and that none is left over
    assert df.where(" or ".join(f"({c})" for c in conditions)).count() == 3050
    others = [s for s, c in zip(sizes, conditions) if " = " not in c]
    assert any(" = " in c for c in conditions) and max(others) < 900
    # rows that were not there when the boundaries were made
    new = spark.sql("select explode(sequence(-50, 2000)) as k").selectExpr(f"{text} as k")
    assert sum(new.where(c).count() for c in conditions) == 2051


def test_splits_of_small_tables_and_their_text(spark):
    none = spark.createDataFrame([], "k string")
    assert split_conditions(none, "k", 4) == ["1 = 1"] and boundaries(none, "k", 4) == [(None, None)]
    one = spark.createDataFrame([("a",)] * 9, "k string")
    assert split_conditions(one, "k", 4) == ['("k" collate "C" < \'a\') or "k" is null', '"k" collate "C" = \'a\'', '"k" collate "C" > \'a\'']
    with pytest.raises(ValueError):
        split_conditions(spark.createDataFrame([(1.0,)], "k double"), "k", 4)


def test_odd_crops_are_counted_while_a_plan_runs(spark):
    df = spark.createDataFrame([("PC", Decimal(1)), ("SC", None), ("XX", None), (None, None), ("xx", None)], "desarrollo string, v decimal(9,2)")
    rows, seen = counted_crops(df)
    assert rows.count() == 5
    assert seen.get == {"filas": 5, "desconocidas": 2, "vacias": 1}
