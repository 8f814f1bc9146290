"""Projects, variants, snapshots and releases as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moves that a release may make.
TRANSITIONS = (("draft", "building"), ("building", "built"), ("building", "failed"), ("built", "validated"), ("built", "failed"), ("validated", "published"), ("published", "retired"), ("failed", "building"))


def variant_matrix(bindings: DataFrame, processing: DataFrame, chunking: DataFrame) -> DataFrame:
    """One cell for each binding, processing and chunking choice: configuration tables; Spark broadcasts those below its own size check."""
    cell = F.concat_ws("|", F.col("binding_id").cast("string"), "processing", "chunking").alias("cell_id")
    return bindings.crossJoin(processing).crossJoin(chunking).select("binding_id", "processing", "chunking", cell)


def parse_cell(df: DataFrame, cell: str = "cell_id") -> DataFrame:
    parts = F.split(cell, r"\|")
    return df.withColumns({"binding_id": parts[0], "processing": parts[1], "chunking": parts[2]})


def reuse(wanted: DataFrame, known: DataFrame, identity: list[str]) -> DataFrame:
    """reused where a known artifact has exactly this identity, else built."""
    have = known.select(*identity).distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, identity, "left").withColumn("outcome", F.when(F.col("_have"), "reused").otherwise("built")).drop("_have")


def illegal_moves(spark: SparkSession, moves: DataFrame) -> DataFrame:
    """moves(release_id, before, after) that the lifecycle does not know."""
    legal = spark.createDataFrame(list(TRANSITIONS), "before string, after string")
    return moves.join(F.broadcast(legal), ["before", "after"], "left_anti")


def engines(bundles: DataFrame, materialised: DataFrame, *, keys: list[str], by: list[str]) -> DataFrame:
    """Sealed materialisations by engine: distinct bundles and distinct materialisations."""
    return bundles.join(materialised.where("status = 'sealed'"), keys).groupBy(*by).agg(F.countDistinct("bundle_id").alias("bundles"), F.countDistinct("materialization_id").alias("materializations"))


def eligibility(candidates: DataFrame) -> DataFrame:
    """processed documents are eligible, those that need review only with an approval; else a reason."""
    ok = (F.col("status") == "processed") | ((F.col("status") == "needs_review") & (F.col("decision") == "approved"))
    reason = F.when(ok, "").when(F.col("status") == "needs_review", F.when(F.col("decision").isNull(), "review_pending").otherwise("review_rejected")).otherwise("not_processed")
    return candidates.withColumn("eligible", F.coalesce(ok, F.lit(False))).withColumn("reason", reason)
