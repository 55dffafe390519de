"""Materialised intermediates.

A table that a later plan reads more than once, or whose content depends on how Spark happened to partition it, is
written to the cluster's shared checkpoint folder and read back. That cuts the lineage, survives the loss of executors
and gives Spark the true file size, so its own broadcast threshold decides join strategies on measured bytes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which every executor must reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return named.rstrip("/")


def name_local_folder(spark: SparkSession) -> SparkSession:
    """For sessions on one machine that name no folder, as in tests: names one that is removed when Python ends."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="emberwatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return spark


def fresh_folder(spark: SparkSession, label: str = "table") -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
