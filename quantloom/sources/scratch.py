"""Tables between the steps of one run, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only where it is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quantloom.tables.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quantloom-')}"
        spark.conf.set("quantloom.tables.dir", named)
    return named.rstrip("/")


def keeper(spark: SparkSession, tag: str) -> Callable[[DataFrame], DataFrame]:
    """Writes a table and reads it back: its lineage ends there, and a lost executor costs only its tasks."""
    root = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    count = iter(range(1 << 30))

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(count):04d}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
