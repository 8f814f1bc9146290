"""Cutting the lineage of loops at files that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may lack the setting; it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A place for a table that nothing else uses."""
    return f"{folder(spark)}/{name}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame as a checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


#: Rows of a partition that ``parts`` aims at.
ROWS = 250_000


def parts(df: DataFrame, rows: int = ROWS) -> int:
    """Partitions that keep about ``rows`` rows each. Short rows else end up by the millions in one task, as partitions are joined by their compressed size; those of a
    repartition by number are not."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
