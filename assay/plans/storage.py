"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder that all executors share, below ``spark.checkpoint.dir``.

    Where that is unset, one is set below this machine's temporary folder for a local master, whose executors are this
    process; any other master is refused, since its executors wouldn't see the folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/assay-{context.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: later stages never recompute it.

    The folder belongs to whoever owns ``spark.checkpoint.dir``, like Spark's own checkpoints: a result that is still
    to be computed reads it, so it can't go before the application ends.
    """
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
