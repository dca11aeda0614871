"""What a session needs so that its Python workers can import this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import Folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Names this checkout to the workers; on a cluster it has to be there, or the package is shipped by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all machines share (spark.checkpoint.dir). What is written there goes when the driver ends.

    Only where all runs in one process may the folder be unset.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    atexit.register(Folder(spark, path).remove)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once, to a shared path, and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
