"""New folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def new_folder(spark: SparkSession, prefix: str) -> str:
    """A path below `spark.checkpoint.dir`. Only a session of one process without that setting gets a
    temporary folder, deleted when it ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="fieldspark-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        shared = f"file://{_local[0]}"
    return f"{shared.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
