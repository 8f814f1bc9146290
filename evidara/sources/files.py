"""Sources and sinks: file inventory, markdown with front matter, JSON lines, OCR tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions.ids import document_id


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row a file: document_id, relpath, extension, category (first folder), content hash, size. Hashing is a column
    expression, so no bytes leave the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    base = F.lit("/" + root.split(":", 1)[-1].strip("/") + "/")
    relpath = F.substr(path, F.length(base) + 1)
    return files.select(
        document_id(relpath).alias("document_id"), relpath.alias("relpath"), extension(relpath, F.col("content")).alias("extension"),
        F.when(F.contains(relpath, F.lit("/")), F.split(relpath, "/")[0]).otherwise("").alias("category"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"),
    )


def extension(relpath: Column, content: Column) -> Column:
    """The suffix in lower case, else pdf by its first bytes."""
    suffix = F.lower(F.regexp_extract(relpath, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix != "", suffix).when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").otherwise("")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """relpath, front (map), body, warning missing_title."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("relpath"), F.col("value").alias("raw"))
    front = F.regexp_extract("raw", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("raw", r"(?s)\A---\n.*?\n---\n", "")
    pairs = F.transform(F.filter(F.split(front, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, F.lit(":")) + 1)).alias("v")))
    return rows.select("relpath", F.map_from_entries(pairs).alias("front"), body.alias("body")).withColumn("warning", F.when(~F.col("body").rlike(r"(?m)^# "), "missing_title"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that parse; damaged lines are left out."""
    return spark.read.schema(f"{schema}, _damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").json(path).where("_damaged is null").drop("_damaged")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words (page_num, block_num, par_num, line_num, left, conf, text) regrouped to lines, with the mean confidence from 0 to 1."""
    line = ["page_num", "block_num", "par_num", "line_num"]
    kept = words.where((F.col("conf") >= 0) & (F.trim("text") != ""))
    return kept.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ").alias("text"), F.round(F.avg(F.col("conf") / 100), 6).alias("confidence"))


def write_sealed(df: DataFrame, path: str) -> bool:
    """Write once: an existing folder stays as it is (False)."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
