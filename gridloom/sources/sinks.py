"""Sinks for dated records and metrics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only where that is unset and executors run in this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, folder: str, asof: str) -> str:
    """Write a dated record; an existing one is never overwritten."""
    path = f"{folder}/asof={asof}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """One JSON line per strategy."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")


def snapshot_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of the dated snapshots below a folder."""
    return spark.read.parquet(folder).select(F.col("asof").cast("string").alias("tag")).distinct()


def prior_tag(tags: DataFrame, tag: str) -> DataFrame:
    """The latest tag strictly before ``tag``; null if none."""
    return tags.filter(F.col("tag") < tag).agg(F.max("tag").alias("prior"))
