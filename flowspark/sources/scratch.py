"""Tables and folders where the cluster shares files (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir.

    Where that is unset, a temporary one if Spark runs on one machine; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='spark-files-', dir='/tmp')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read back."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
