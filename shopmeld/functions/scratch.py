"""The shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A folder per application below spark.checkpoint.dir, which may be removed when it has ended.

    A local session without that setting uses one temporary folder that goes when the process ends;
    on a cluster the setting is required, because its machines share no temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="shopmeld-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        configured = f"file://{_LOCAL[0]}"
    return f"{configured.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back: its rows can no longer change when
    a lost executor makes Spark recompute them, and the plan behind it is cut."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
