"""The relational database as a source."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from fieldspark.sources.schemas import DATED
from fieldspark.sources.tables import Tables


def scan_options(
    name: str,
    url: str,
    *,
    since: dt.date,
    until: dt.date,
    partitions: int = 64,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of one table scan.

    Dated tables are read by `partitions` tasks, each with its own date interval between `since`
    and `until`; rows outside fall to the first and last task, so nothing is lost. The others are
    read by one task, in batches of `fetch_size` rows.
    """
    options = {"url": url, "dbtable": name, "fetchsize": str(fetch_size)}
    if name in DATED:
        options |= {
            "partitionColumn": "fecha",
            "lowerBound": since.isoformat(),
            "upperBound": until.isoformat(),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_tables(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    *,
    since: dt.date,
    until: dt.date,
    partitions: int = 64,
    fetch_size: int = 10_000,
    splits: Mapping[str, Sequence[str]] | None = None,
) -> Tables:
    """Tables of the database at `url`; errors of the connection are raised, not returned as rows.

    `splits` gives a table its own division: one condition per task, which together must cover
    every row once. Use it for large tables without a date, such as the quality counters, and
    where single dates are very busy. `properties` carries user, password, driver and TLS settings. Projections and filters of the
    queries are pushed into the statements Spark sends. For repeated work copy the tables once
    with `store.write_tables`.
    """

    splits = splits or {}

    def read(name: str):
        if name in splits:
            own = {**properties, "fetchsize": str(fetch_size)}
            return spark.read.jdbc(url, name, predicates=list(splits[name]), properties=own)
        options = scan_options(
            name, url, since=since, until=until, partitions=partitions, fetch_size=fetch_size
        )
        return spark.read.format("jdbc").options(**properties, **options).load()

    return Tables(read)
