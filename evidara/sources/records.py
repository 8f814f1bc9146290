"""Readers of JSON lines with a stated shape: chunks, golden documents, evaluation questions, review decisions. What cannot be used is a row with its file and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """schema of a line; key: columns that name it; required: columns that may not be null; one_of: allowed values of columns."""

    schema: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    one_of: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: The fields of each kind of line.
PARENTS = Shape("chunk_id string, document_id string, profile_id string, ordinal bigint, text string, block_ids array<string>", ("chunk_id",), ("document_id", "text"))
CHILDREN = Shape("chunk_id string, parent_id string, document_id string, profile_id string, ordinal bigint, text string, context_prefix string, token_count bigint", ("chunk_id",), ("parent_id", "document_id", "text"))
GOLDEN = Shape("document_id string, source_relpath string, page_count bigint, expected map<string,string>, anchors array<string>, review_status string", ("source_relpath",), ("document_id", "page_count"))
QUESTIONS = Shape("question_id string, question string, relevant_document_ids array<string>, expected_page bigint", ("question_id",), ("question", "relevant_document_ids"))
DECISIONS = Shape("document_id string, source_relpath string, decision string, reason string, decided_at timestamp", ("document_id", "decided_at"), ("decision",), (("decision", ("approved", "rejected", "needs_review")),))


def read(spark: SparkSession, path: str, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """(usable lines, refused lines (file, line, reason)). Blank lines are no lines. Reasons, the first that applies: invalid_json, missing_<field>, bad_<field>,
    repeated_key (all lines of a key that stands more than once with different contents; equal ones count once)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    rows = lines.select("file", "line", F.from_json("line", f"{shape.schema}, _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}).alias("x"))
    missing = [F.when(F.col(f"x.{c}").isNull(), f"missing_{c}") for c in (*shape.key, *shape.required)]
    bad = [F.when(~F.col(f"x.{c}").isin(*values), f"bad_{c}") for c, values in shape.one_of]
    rows = rows.withColumn("reason", F.coalesce(F.when(F.col("x").isNull() | F.col("x._damaged").isNotNull(), "invalid_json"), *missing, *bad))
    good = rows.where("reason is null").select("file", "line", *[f"x.{c.split()[0]}" for c in shape.schema.split(", ")])
    keys = good.groupBy(*shape.key).agg((F.min("line") != F.max("line")).alias("_several"), F.min(F.struct("file", "line")).alias("_first"))
    judged = good.join(keys, list(shape.key))
    first = (F.col("file") == F.col("_first.file")) & (F.col("line") == F.col("_first.line"))
    usable = judged.where(~F.col("_several") & first).drop("file", "line", "_several", "_first").dropDuplicates(list(shape.key))
    refused = rows.where("reason is not null").select("file", "line", "reason").unionByName(judged.where("_several").select("file", "line", F.lit("repeated_key").alias("reason")))
    return usable, refused


def chunks(spark: SparkSession, parents: str, children: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, children with the text and ordinal of their parent, refused lines). A child whose parent is not there, or is of another document, is refused."""
    up, bad_up = read(spark, parents, PARENTS)
    down, bad_down = read(spark, children, CHILDREN)
    known = up.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"), F.col("ordinal").alias("parent_ordinal"), F.col("document_id").alias("_document"))
    joined = down.join(known, "parent_id", "left").withColumn("_reason", F.when(F.col("_document").isNull(), "unknown_parent").when(F.col("_document") != F.col("document_id"), "parent_of_other_document"))
    lost = joined.where("_reason is not null").select(F.lit(None).cast("string").alias("file"), F.col("chunk_id").alias("line"), F.col("_reason").alias("reason"))
    return up, joined.where("_reason is null").drop("_document", "_reason"), bad_up.unionByName(bad_down).unionByName(lost)


def children_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_id, children): the children of each of the parents(chunk_id) in order; an empty array for those without any."""
    listed = children.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("c"))
    found = parents.select(F.col("chunk_id").alias("parent_id")).join(listed, "parent_id", "left")
    return found.select("parent_id", F.coalesce(F.transform("c", lambda x: x["chunk_id"]), F.array().cast("array<string>")).alias("children"))
