"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder if it is unset and Spark runs in one process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="fieldspark-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes a frame as Parquet and returns it read back: lost executors cost no recomputation,
    and what is used several times is computed once. Like checkpoints, the files stay until the
    folder is cleaned."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that is not read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shipped(spark: SparkSession, value) -> Broadcast:
    """Broadcasts an object of this package; ``received`` gives it back in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast):
    return cloudpickle.loads(broadcast.value)


def whole_row(df: DataFrame) -> Column:
    """All columns of a frame as one struct, which no column added beside it can clash with."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
