"""Date expressions. Reports take an explicit `as_of` date in place of the clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names.
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)

# First and last day (month, day) of each quarter.
QUARTERS = {
    1: ((1, 1), (3, 31)),
    2: ((4, 1), (6, 30)),
    3: ((7, 1), (9, 30)),
    4: ((10, 1), (12, 31)),
}


def in_ranges(column: Column, ranges: Sequence[tuple]) -> Column:
    """Whether the column lies in one of the half-open ranges; None leaves an end open."""

    def within(lo, hi) -> Column:
        if lo is None and hi is None:
            return column.isNotNull()
        ends = []
        if lo is not None:
            ends.append(column >= F.lit(lo))
        if hi is not None:
            ends.append(column < F.lit(hi))
        return reduce(Column.__and__, ends)

    return reduce(Column.__or__, [within(lo, hi) for lo, hi in ranges], F.lit(False))


def year_ranges(year: int | None) -> list[tuple[dt.date, dt.date]] | None:
    """The dates of a calendar year, or None for no limit."""
    return None if year is None else [(dt.date(year, 1, 1), dt.date(year + 1, 1, 1))]


def week_ranges(year: int | None, week: int | None) -> list[tuple[dt.date, dt.date]] | None:
    """The dates of calendar year `year` that carry ISO week number `week`.

    The year is the calendar one: 1 January 2021 counts as week 53 of 2021, and the last days of
    a December may carry week 1. That gives up to two ranges per week number.
    """
    if year is None or week is None:
        if week is not None:
            raise ValueError("a week needs its year")
        return year_ranges(year)
    ranges: list[tuple[dt.date, dt.date]] = []
    day = dt.date(year, 1, 1)
    while day.year == year:
        end = day + dt.timedelta(days=1)
        if day.isocalendar().week == week:
            if ranges and ranges[-1][1] == day:
                ranges[-1] = (ranges[-1][0], end)
            else:
                ranges.append((day, end))
        day = end
    return ranges


def program_defaults(as_of: dt.date) -> dict[str, object]:
    """ISO year and week of `as_of`, and the years offered around it."""
    year, week, _ = as_of.isocalendar()
    return {"anio": year, "semana": week, "anios": [year - 1, year, year + 1]}


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def days_since(date: Column, as_of: dt.date) -> Column:
    """Whole days from `date` to `as_of`; negative for later dates."""
    return F.datediff(F.lit(as_of), date)


def months_between_days(end: Column, start: Column) -> Column:
    """Days between two dates in months of 30 days."""
    return F.datediff(end, start) / F.lit(30)


def months_since(date: Column, as_of: dt.date) -> Column:
    return months_between_days(F.lit(as_of), date)


def spanish_date(date: Column) -> Column:
    """`07-julio-2021`."""
    months = F.expr("array(" + ", ".join(f"'{m}'" for m in MONTHS) + ")")
    day = F.lpad(F.day(date).cast("string"), 2, "0")
    month = F.element_at(months, F.month(date))
    return F.concat(day, F.lit("-"), month, F.lit("-"), F.year(date).cast("string"))


def quarter_share(start: Column, end: Column, quarter: int) -> Column:
    """Share of the days from `start` to `end` that fall in a quarter of the year.

    Each year adds the day difference between the first and last covered day of the quarter, so
    it counts one day less than a calendar would, and the four shares do not add up to one.
    Null when a date is null or both are the same day.
    """
    if quarter not in QUARTERS:
        raise ValueError(f"quarter must be 1 to 4, not {quarter!r}")
    (first_month, first_day), (last_month, last_day) = QUARTERS[quarter]

    def days(year: Column) -> Column:
        begins = F.greatest(start, F.make_date(year, F.lit(1), F.lit(1)))
        ends = F.least(end, F.make_date(year, F.lit(12), F.lit(31)))
        touched = (F.month(begins) <= last_month) & (F.month(ends) >= first_month)
        quarter_first = F.make_date(year, F.lit(first_month), F.lit(first_day))
        quarter_last = F.make_date(year, F.lit(last_month), F.lit(last_day))
        span = F.datediff(F.least(quarter_last, ends), F.greatest(quarter_first, begins))
        return F.when(touched, span).otherwise(0)

    years = F.when(
        F.year(start) <= F.year(end), F.sequence(F.year(start), F.year(end))
    ).when(F.datediff(end, start).isNotNull(), F.array().cast("array<int>"))
    total = F.aggregate(years, F.lit(0), lambda acc, year: acc + days(year))
    return F.try_divide(total.cast("double"), F.datediff(end, start).cast("double"))
