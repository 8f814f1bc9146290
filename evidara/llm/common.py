"""Helpers that the operators share: input records, shared tables, samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session may lack the setting; it then gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, *, partition: Sequence[str] = (), batch: int | None = None) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: later jobs start from files that
    survive the loss of executors, and the shuffles that made it can go.

    batch: bytes of rows that go to Python at a time (one row at least), if not Spark's own 64 MB."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true"} | ({ARROW_BYTES: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, x in wanted.items():
            spark.conf.set(k, x)
        writer = df.write
        (writer.partitionBy(*partition) if partition else writer).option("compression", "zstd").parquet(path)
    finally:
        for k, x in before.items():
            if x is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, x)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing will read it again."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def records(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key as bigint and the named columns, one row per non-null key.

    The check for repeated keys reads the key column alone; texts are shuffled only if there are any."""
    out = df.select(F.col(key).cast("bigint").alias(key), *columns).where(F.col(key).isNotNull())
    repeated = out.groupBy(key).count().where("count > 1").limit(1)
    if repeated.isEmpty():
        return out
    rest = [F.struct(*columns).alias("_row")] if columns else []
    if not rest:
        return out.distinct()
    return out.select(key, *rest).groupBy(key).agg(F.min("_row").alias("_row")).select(key, "_row.*")


#: Rows of the samples that name the most common hashes, and hashes that they name at most.
SAMPLE, NAMED = 10_000, 1 << 16


def sampled(df: DataFrame, key: str, size: int = SAMPLE) -> DataFrame:
    """About ``size`` rows, by a hash of the key; all, if there are fewer. Samples only say where rows go or what needs no
    counting; they never decide a result."""
    every = max(1, df.count() // size)
    return df.where(F.pmod(F.xxhash64(F.lit(0x5A), key), F.lit(every)) == 0)
