"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine (master ``local``) takes a temporary folder; a cluster raises an error, because
    its executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
    if getattr(sc, "_textloom_scratch", None) is None:
        sc._textloom_scratch = tempfile.mkdtemp(prefix="spark-textloom-")
    return sc._textloom_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
