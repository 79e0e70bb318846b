"""Conditions that divide a table without a date among tasks, for `jdbc_tables(splits=...)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are sampled to find the boundaries.
SAMPLE = 20_000


def boundaries(rows: DataFrame, key: str, parts: int, sample: int = SAMPLE) -> list[tuple]:
    """Ranges (first, end) of the key that have about as many rows each: first included, end not, None
    for no limit. A key with more rows than a part is a range of its own, (key, key).

    Rows are counted by key; the driver gets the keys that are larger than a part, fewer than `parts`, and
    `sample` others, those with the smallest hashes, with their counts.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    total, keys = counts.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return [(None, None)]
    share = total / parts
    heavy = {r.k for r in counts.where(F.col("n") > share).collect()}
    others = counts.where(F.col("n") <= share)
    taken = others.orderBy(F.xxhash64("k"), "k").limit(sample).collect()
    scale = (keys - len(heavy)) / len(taken) if taken else 1.0
    weights = sorted([(r.k, r.n * scale) for r in taken] + [(k, share) for k in heavy])
    ranges, first, sum_ = [], None, 0.0
    for k, n in weights:
        if k in heavy:
            ranges += [(first, k), (k, k)] if ranges or sum_ or first is None else [(k, k)]
            first, sum_ = (k,), 0.0  # behind k
            continue
        if sum_ + n > share and sum_:
            ranges.append((first, k))
            first, sum_ = k, 0.0
        sum_ += n
    return [*ranges, (first, None)]


def _literal(value, kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(kind, T.DateType):
        return f"DATE '{value.isoformat()}'"
    if isinstance(kind, T.TimestampType):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    return str(value)


def split_conditions(
    rows: DataFrame, key: str, parts: int, sample: int = SAMPLE, quote: str = '"', collate: str | None = '"C"'
) -> Sequence[str]:
    """SQL conditions on `key`, of which every row, one without a key included, satisfies exactly one.

    `quote` surrounds the column's name. Texts are compared by code points, in the database by the collation
    `collate` (None where that is the order anyway, as in Spark). `rows` may be an earlier copy: how
    even the parts are depends on it, that they cover the table does not.
    """
    kind = rows.schema[key].dataType
    if not isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.IntegralType, T.DecimalType)):
        raise ValueError(f"cannot split by {key}, a {kind.simpleString()}")
    name = f"{quote}{key}{quote}"
    column = f"{name} collate {collate}" if collate and isinstance(kind, T.StringType) else name
    found = []
    for first, end in boundaries(rows, key, parts, sample):
        limits = []
        if first is not None and first == end and not isinstance(first, tuple):
            limits = [f"{column} = {_literal(first, kind)}"]
        else:
            if isinstance(first, tuple):
                limits.append(f"{column} > {_literal(first[0], kind)}")
            elif first is not None:
                limits.append(f"{column} >= {_literal(first, kind)}")
            if end is not None:
                limits.append(f"{column} < {_literal(end, kind)}")
        found.append(" and ".join(limits))
    if found == [""]:
        return ["1 = 1"]
    return [f"({found[0]}) or {name} is null", *found[1:]]
