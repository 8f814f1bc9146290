"""Sinks whose readers never see half a write: manifests, stored responses, staged vectors, promotion with a backup. All work on any file system that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.functions import vectors as V

#: The media types of the extensions that are read.
MEDIA_TYPES = {"pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "json": "application/json", "html": "text/html", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
SCHEMA_VERSION = "2.0"


def media_type(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(table[F.lower(extension)], F.lit("application/octet-stream"))


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished folder in place of another: the old one stands aside until the new one is there, and comes back if it cannot be put there."""
    fs, new = _files(spark, staged)
    _, live = _files(spark, path)
    _, aside = _files(spark, f"{path}.backup")
    fs.delete(aside, True)
    had = fs.exists(live)
    if had and not fs.rename(live, aside):
        raise OSError(f"cannot set {path} aside")
    try:
        done = fs.rename(new, live)
    except Exception:
        done = False
    if not done:
        if had:
            fs.rename(aside, live)
        raise OSError(f"cannot put {staged} in place of {path}; the old folder is back")
    fs.delete(aside, True)


def write_manifests(root: str, *, generated_at: str, run_id: str, **frames: DataFrame) -> None:
    """Manifests (inventory, run, review, errors) as folders of JSON lines below ``root``, each record with the schema's version, the run and the time.

    Each is written beside its place and then put there, so a reader sees the old or the new one."""
    for name, df in frames.items():
        rows = df.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(run_id).alias("run_id"), F.lit(generated_at).alias("generated_at"), *[F.col(c) for c in df.columns if c not in ("schema_version", "run_id", "generated_at")])
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/.{name}.staged")
        _replace(df.sparkSession, f"{root}/.{name}.staged", f"{root}/{name}")


def write_responses(responses: DataFrame, root: str, *, key: str = "document_id", body: str = "body") -> None:
    """Provider responses (key, configuration_hash, capability, body) without their secrets, in one folder a capability; a later call adds to them."""
    safe = F.regexp_replace("configuration_hash", "[^A-Za-z0-9_.-]", "_")
    responses.select(key, safe.alias("configuration_hash"), "capability", T.redact_json(F.col(body)).alias(body)).write.mode("append").partitionBy("capability").parquet(root)


def stage_vectors(vectors: DataFrame, root: str, *, key: str = "node_id", vector: str = "embedding") -> str:
    """Vectors with a checksum each in a staging folder; returns its path. Nothing reads it before ``promote_vectors``."""
    staged = f"{root}.staged"
    vectors.withColumn("vector_checksum", V.checksum(F.col(vector))).write.mode("overwrite").parquet(staged)
    return staged


def broken_vectors(spark: SparkSession, path: str, dimension: int, *, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """(key, reason) of stored vectors that are not what was written, or not of the dimension."""
    rows = spark.read.parquet(path)
    reason = F.when(F.col(vector).isNull() | (F.size(vector) != dimension), "dimension").when(~V.checksum(F.col(vector)).eqNullSafe(F.col("vector_checksum")), "checksum")
    return rows.select(key, reason.alias("reason")).where("reason is not null")


def promote_vectors(spark: SparkSession, staged: str, root: str, dimension: int, *, key: str = "node_id", vector: str = "embedding") -> None:
    """Staged vectors go live if all of them are whole; else the live ones stay and the staged folder is left for inspection."""
    if not broken_vectors(spark, staged, dimension, key=key, vector=vector).isEmpty():
        raise ValueError(f"{staged} holds damaged vectors")
    _replace(spark, staged, root)


def vectors(spark: SparkSession, path: str, dimension: int, *, key: str = "node_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors of the dimension as array of float, rows of another dimension or with null or non-finite components)."""
    rows = spark.read.parquet(path)
    whole = (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.coalesce(whole, F.lit(False))
    return rows.where(whole).withColumn(vector, F.col(vector).cast("array<float>")), rows.where(~whole)


def promote(spark: SparkSession, candidate: str, live: str, *, structural_status: str) -> None:
    """A candidate tree takes the place of the live one if its validation passed; the old tree comes back if that fails halfway."""
    if structural_status != "passed":
        raise ValueError("the candidate has not passed structural validation")
    fs, source = _files(spark, candidate)
    if not fs.exists(source):
        raise ValueError("there is no candidate")
    _, copy = _files(spark, f"{live}.staged")
    fs.delete(copy, True)
    conf = spark._jsc.hadoopConfiguration()
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, copy, False, conf):
        raise OSError(f"cannot copy {candidate}")
    _replace(spark, f"{live}.staged", live)


def normalized_documents(bodies: DataFrame, required: dict[str, DataFrame], optional: dict[str, DataFrame], *, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(documents with a column for each sidecar and whether optional ones are there, refused rows (key, reason)).

    bodies(key, markdown, content_hash), sidecars(key, content_hash, payload): a document without a required sidecar, or with one of another
    content, is refused, as is an empty body; a sidecar without a document is an orphan."""
    rows = bodies.select(key, "markdown", F.col("content_hash").alias("_hash"), F.lit(True).alias("_body"))
    reasons = [F.when(F.col("_body").isNull(), "orphan_sidecar"), F.when(F.trim(F.coalesce("markdown", F.lit(""))) == "", "empty_body")]
    for name, df in {**required, **optional}.items():
        rows = rows.join(df.select(key, F.col("payload").alias(name), F.col("content_hash").alias(f"_{name}"), F.lit(True).alias(f"{name}_present")), key, "full_outer")
        if name in required:
            reasons.append(F.when(F.col(f"{name}_present").isNull(), f"missing_{name}"))
        reasons.append(F.when(F.col(f"{name}_present") & ~F.col(f"_{name}").eqNullSafe(F.col("_hash")), f"other_content_{name}"))
    judged = rows.withColumn("reason", F.coalesce(*reasons))
    names = [*required, *optional]
    good = judged.where("reason is null").select(key, "markdown", *names, *[F.coalesce(f"{x}_present", F.lit(False)).alias(f"{x}_present") for x in optional])
    return good, judged.where("reason is not null").select(key, "reason")
