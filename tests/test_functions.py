import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldspark.functions import dates, rules, text


def values(spark, column, rows=None, schema=None):
    df = spark.range(1) if rows is None else spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column.alias("v")).collect()]


def days_share(start, end, quarter):
    """Day by day: days of the quarter in the span, less one for each year that has any."""
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    hit = [d for d in days if (d.month - 1) // 3 + 1 == quarter]
    return (len(hit) - len({d.year for d in hit})) / (end - start).days


def test_quarter_share_by_hand(spark):
    rows = [(dt.date(2020, 11, 10), dt.date(2021, 3, 30))]
    got = [
        values(spark, dates.quarter_share(F.col("s"), F.col("e"), q), rows, "s date, e date")[0]
        for q in (1, 2, 3, 4)
    ]
    assert got == [88 / 140, 0.0, 0.0, 51 / 140]


def test_quarter_share_equals_day_count(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        start = dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(2000))
        rows.append((start, start + dt.timedelta(days=rng.randrange(1, 1500))))
    for quarter in (1, 2, 3, 4):
        share = dates.quarter_share(F.col("s"), F.col("e"), quarter)
        got = values(spark, share, rows, "s date, e date")
        assert got == pytest.approx([days_share(s, e, quarter) for s, e in rows])


def test_quarter_share_edges(spark):
    day = dt.date(2020, 5, 1)
    rows = [(None, day), (day, None), (day, day), (dt.date(2021, 5, 1), day)]
    share = dates.quarter_share(F.col("s"), F.col("e"), 2)
    # An end in an earlier year covers no year at all.
    assert values(spark, share, rows, "s date, e date") == [None, None, None, 0.0]
    with pytest.raises(ValueError):
        dates.quarter_share(F.col("s"), F.col("e"), 5)


def test_week_ranges_equal_the_calendar():
    for year in range(2014, 2027):
        days = [dt.date(year, 1, 1) + dt.timedelta(days=i) for i in range(366)]
        days = [d for d in days if d.year == year]
        for week in (1, 2, 20, 51, 52, 53):
            want = [d for d in days if d.isocalendar().week == week]
            ranges = dates.week_ranges(year, week)
            got = [d for d in days if any(a <= d < b for a, b in ranges)]
            assert got == want
    assert dates.week_ranges(2021, 53) == [(dt.date(2021, 1, 1), dt.date(2021, 1, 4))]
    assert len(dates.week_ranges(2024, 1)) == 2
    assert dates.week_ranges(None, None) is None
    with pytest.raises(ValueError):
        dates.week_ranges(None, 3)


def test_no_range_matches_nothing(spark):
    # Week 53 does not occur in 2022 outside its first days' week 52.
    ranges = dates.week_ranges(2022, 53)
    assert ranges == []
    day = F.lit(dt.date(2022, 1, 1))
    assert values(spark, dates.in_ranges(day, ranges)) == [False]


def test_spanish_date(spark):
    rows = [(dt.date(2021, 7, 7),), (dt.date(2019, 12, 31),), (None,)]
    got = values(spark, dates.spanish_date(F.col("d")), rows, "d date")
    assert got == ["07-julio-2021", "31-diciembre-2019", None]


def test_days_since_future_date(spark):
    day = F.lit(dt.date(2020, 1, 11))
    assert values(spark, dates.days_since(day, dt.date(2020, 1, 1))) == [-10]
    assert values(spark, dates.months_since(day, dt.date(2020, 1, 26))) == [0.5]


def test_program_defaults():
    assert dates.program_defaults(dt.date(2021, 1, 1)) == {
        "anio": 2020,
        "semana": 53,
        "anios": [2019, 2020, 2021],
    }


def test_timing_rules_differ_on_unknown_quality(spark):
    rows = [(q,) for q in (0, 1, 2, 3, 4, 5, None)]
    c = F.col("c")
    assert values(spark, rules.timing_strict(c), rows, "c int") == [
        "adelantada", "adelantada", "en el rango", "tardía", "tardía", "validar", "validar",
    ]
    assert values(spark, rules.timing_lenient(c), rows, "c int") == [
        "adelantada", "adelantada", "en el rango", "tardía", "tardía", "en el rango", "en el rango",
    ]
    assert values(spark, rules.timing_score(c), rows, "c int") == [1, 1, 2, 3, 3, 2, 2]


def test_current_group_does_not_fall_back(spark):
    day = dt.date(2020, 1, 1)
    names = (
        "grupo_siembra grupo_forza grupo_semillero grupo_2da_cosecha grupo_forza2 "
        "siembra finduccion poda deshija finduccion2"
    ).split()
    groups = ["GS1", "GF1", "GE1", "GS2", "GF2"]
    rows = [
        [*groups, None, None, None, None, None],
        [*groups, day, None, None, None, None],
        [*groups, day, day, None, None, None],
        [*groups, day, day, day, None, None],
        [*groups, day, day, None, day, None],
        [*groups, None, None, None, None, day],
        ["GS1", None, "GE1", "GS2", "GF2", day, day, None, None, None],
    ]
    schema = ", ".join(f"{n} {'string' if n.startswith('grupo') else 'date'}" for n in names)
    got = values(spark, rules.current_group(), rows, schema)
    assert got == ["VALIDAR GRUPO", "GS1", "GF1", "GE1", "GS2", "GF2", None]


def test_in_list(spark):
    rows = [("a",), ("b",), (None,)]
    assert values(spark, rules.in_list(F.col("x"), []), rows, "x string") == [False] * 3
    assert values(spark, rules.in_list(F.col("x"), ["a", "a"]), rows, "x string") == [
        True, False, None,
    ]


def test_ratio_by_zero_is_null(spark):
    rows = [Row(a=1.0, b=0.0), Row(a=3.0, b=2.0), Row(a=None, b=2.0)]
    assert values(spark, rules.ratio(F.col("a"), F.col("b")), rows, "a double, b double") == [
        None, 1.5, None,
    ]


def test_text(spark):
    null = F.lit(None).cast("string")
    assert values(spark, text.link(null, "/a?b=", null)) == ["[](/a?b=)"]
    assert values(spark, text.block_key(null, F.lit("01"))) == ["01"]
    assert values(spark, text.labelled(null, F.lit("x"))) == [None]
    assert values(spark, text.lot_of_block(F.lit("PC0712345"))) == ["07"]
    assert values(spark, text.fold_accents(F.lit("Protección"))) == ["Proteccion"]
    assert values(spark, text.plain_text(F.lit("a [b c](/d?e=f#g), [](/h)"))) == ["a b c, "]
    assert values(spark, text.spaced(text.underscored(F.lit("F 3 a")))) == ["F 3 a"]


def test_plain_text_of_targets_with_parentheses(spark):
    rows = [("[F 1 (x)](/detalle?codigo=F_1_(x)), [B](/b)",), ("no (link)",), ("[a](b(c(d)))e",)]
    got = spark.createDataFrame(rows, "t string").select(text.plain_text(F.col("t"))).collect()
    assert [r[0] for r in got] == ["F 1 (x), B", "no (link)", "ae"]
