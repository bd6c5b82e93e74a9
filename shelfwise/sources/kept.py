"""Tables between the steps of a job: written to the shared folder and read again, so that they are made once and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; only a local master may take one of its own."""
    shared, app = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.applicationId
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = _local.setdefault(app, tempfile.mkdtemp(prefix="shelfwise-kept-"))
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
