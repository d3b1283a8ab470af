"""Cutting lineage in the folder that all executors share, and what keeps long chains of cuts within bounds."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver has it.

    On a cluster without a shared file system the package goes out with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without the setting a temporary one on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored reliably, so that a lost executor costs no recomputation upstream."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join by sorting both sides, whatever the broadcast threshold: no side that grows with the rows passes through the driver.

    In a long chain of joins the driver would hold many broadcast tables at once, each under the threshold by itself.
    """
    return left.join(right.hint("merge"), on, how)


def release(spark: SparkSession) -> None:
    """Have the driver drop plans that are done with, so that their shuffle files and broadcasts are deleted now.

    Spark deletes them when the driver's garbage is collected, which may be long after the disk they hold is needed. The
    listeners hold the last event they saw, and with it the last plan: a small job takes its place. What Python let go
    is told to the JVM by a thread that looks once a second.
    """
    spark.range(1).count()
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the one that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
