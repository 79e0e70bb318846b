"""Lazy access to the domain tables, whatever they are stored in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.dates import in_ranges
from fieldspark.sources.schemas import SCHEMAS

YEAR_PARTITION = "anio"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _accepted(actual: T.DataType, declared: T.DataType) -> bool:
    """Whether `actual` holds values of `declared` without loss."""
    if actual == declared:
        return True
    if isinstance(declared, T.DateType):
        return isinstance(actual, (T.TimestampType, T.TimestampNTZType))
    if isinstance(declared, T.DecimalType):
        return isinstance(actual, (T.DecimalType, *_WHOLE))
    if isinstance(declared, T.DoubleType):
        return isinstance(actual, (T.FloatType, T.ByteType, T.ShortType, T.IntegerType))
    if isinstance(declared, _WHOLE):
        return isinstance(actual, _WHOLE) and _WHOLE.index(type(actual)) < _WHOLE.index(type(declared))
    return False


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of table `name`; ValueError when one is missing or of another type.

    Timestamps become dates here. Spark turns a date range on the cast column into a range on the
    stored timestamp, so filters above still reach the scan. Decimals keep their own scale.
    """
    declared = SCHEMAS[name]
    found = {f.name: f.dataType for f in df.schema.fields}
    if [(f.name, f.dataType) for f in declared.fields] == list(found.items()):
        return df
    faults, columns = [], []
    for field in declared.fields:
        actual = found.get(field.name)
        wanted = field.dataType.simpleString()
        if actual is None:
            faults.append(f"{field.name} is missing")
        elif not _accepted(actual, field.dataType):
            faults.append(f"{field.name} is {actual.simpleString()}, expected {wanted}")
        elif actual == field.dataType or isinstance(actual, T.DecimalType):
            columns.append(field.name)
        else:
            columns.append(f"cast({field.name} as {wanted}) as {field.name}")
    if faults:
        raise ValueError(f"table {name}: " + "; ".join(faults))
    return df.selectExpr(*columns)


class Tables:
    """The domain tables as DataFrames: `tables.aplicaciones`, `tables.blocks`, ...

    `read` returns the stored DataFrame for a table name. Nothing is read before it is asked for.
    `co_located` tables lie in buckets of blocks, which reports are to leave where they are.
    """

    def __init__(self, read: Callable[[str], DataFrame], co_located: bool = False):
        self._read, self.co_located = read, co_located
        self._stored: dict[str, DataFrame] = {}
        self._conformed: dict[str, DataFrame] = {}

    def _raw(self, name: str) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = self._read(name)
        return self._stored[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._conformed:
            self._conformed[name] = conform(self._raw(name), name)
        return self._conformed[name]

    def dated(
        self,
        name: str,
        ranges: Sequence[tuple[dt.date | None, dt.date | None]] | None,
        *,
        keep_null: bool = False,
    ) -> DataFrame:
        """Rows of `name` whose `fecha` lies in one of the half-open ranges (all rows for None).

        The ranges are stated on the plain column, so they reach the scan, and again on the year
        partition where the store has one, so that other years are not even listed. With
        `keep_null`, rows without a date stay.
        """
        raw = self._raw(name)
        if ranges is None:
            return getattr(self, name)
        wanted = in_ranges(F.col("fecha"), ranges)
        if YEAR_PARTITION in raw.columns:
            years = [
                (lo and lo.year, hi and (hi - dt.timedelta(days=1)).year + 1) for lo, hi in ranges
            ]
            wanted = wanted & in_ranges(F.col(YEAR_PARTITION), years)
        if keep_null:
            unknown = F.col("fecha").isNull()
            if YEAR_PARTITION in raw.columns:
                unknown = unknown & F.col(YEAR_PARTITION).isNull()
            wanted = wanted | unknown
        return conform(raw.where(wanted), name)


def frame_tables(frames: Mapping[str, DataFrame]) -> Tables:
    """Tables over DataFrames at hand."""
    return Tables(frames.__getitem__)


def parquet_tables(spark: SparkSession, root: str) -> Tables:
    """Tables stored as one parquet folder (or file) each below `root`."""
    return Tables(lambda name: spark.read.parquet(f"{root}/{name}"))
