"""Run registered queries in Spark and DuckDB and compare the rows.

    python -m verification.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from verification.oracles import ORACLES
from verification.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: str = "8", shuffle_partitions: str | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldspark")
        .config("spark.sql.shuffle.partitions", shuffle_partitions or cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (float, np.floating)):
        return None if np.isnan(value) else float(f"{float(value):.12g}")
    if isinstance(value, (int, np.integer, Decimal)):
        return float(value)
    if isinstance(value, (dt.datetime, pd.Timestamp)):
        return pd.Timestamp(value).date().isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def rows_of(frame: pd.DataFrame) -> Counter:
    """Rows as a multiset, columns in name order."""
    ordered = frame[sorted(frame.columns)]
    return Counter(
        tuple(map(_plain, row)) for row in ordered.astype(object).itertuples(index=False, name=None)
    )


def spark_frame(df: DataFrame) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)


_KINDS = {
    "string": "VARCHAR", "date": "DATE", "int": "INTEGER", "bigint": "BIGINT",
    "double": "DOUBLE", "boolean": "BOOLEAN",
}


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, name: str) -> list[str]:
    """What differs between the two engines for one query; empty when all is equal."""
    got = spark_frame(df)
    if name not in ORACLES:
        return [] if len(got) else ["no rows"]
    result = con.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    columns = [d[0] for d in result.description]
    want = pd.DataFrame(result.fetchall(), columns=columns)
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    found = []
    for field in df.schema.fields:
        kind = _KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if types[field.name] != kind:
            found.append(f"type of {field.name}: {kind} != {types[field.name]}")
    mine, theirs = rows_of(got), rows_of(want)
    if mine != theirs:
        found.append(
            f"{len(got)} rows against {len(want)}; "
            f"only Spark {list((mine - theirs).items())[:2]}; "
            f"only DuckDB {list((theirs - mine).items())[:2]}"
        )
    return found


def main(sf_dir: str, names: list[str]) -> int:
    spark, con = local_session(), duck_connection(sf_dir)
    failed = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            found = differences(QUERIES[name](spark, sf_dir), con, name)
        except Exception as error:  # keep going: this is a report
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        rows = "rows only" if name not in ORACLES else "equal"
        print(f"{time.time() - begin:6.1f}s {name}: {'; '.join(found) if found else rows}", flush=True)
        failed += bool(found) and not all(f.startswith("type") for f in found)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
