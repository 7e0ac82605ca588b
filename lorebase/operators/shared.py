"""Tables that a plan writes on its way: below spark.checkpoint.dir, which the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI. Only a local session may do without the setting and gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorebase-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lorebase-{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df and reads it again: what is read later is what was written, whatever executors are lost."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
