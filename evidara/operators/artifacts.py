"""Document artifacts: nodes, page merges and alignment, responses, old schemas, HTML tables, checked writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nodes(parents: DataFrame, children: DataFrame, parent_id: str = "parent_id") -> DataFrame:
    """(node_id, parent_node_id, node_role, text): parents without and children with a parent."""
    up = parents.select(F.col(parent_id).alias("node_id"), F.lit(None).cast("string").alias("parent_node_id"), F.lit("parent").alias("node_role"), "text")
    down = children.select("node_id", F.col(parent_id).alias("parent_node_id"), F.lit("child").alias("node_role"), "text")
    return up.unionByName(down)


def grouped(children: DataFrame, parent: str, order: str, value: str) -> DataFrame:
    """(parent, children array in order, n)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return children.groupBy(parent).agg(listed.alias("children"), F.count("*").alias("n"))


def merge_regions(pages: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """pages(keys, text) with the texts of regions(keys, ordinal, text) that the page does not hold yet, in order, each once."""
    found = regions.where("text <> ''").groupBy(*keys).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])).alias("_regions"))
    fresh = F.filter(F.coalesce("_regions", F.array().cast("array<string>")), lambda x: ~F.coalesce(F.col("text").contains(x), F.lit(False)))
    return pages.join(found, keys, "left").withColumn("added", F.size(fresh)).withColumn("text", F.array_join(F.concat(F.array(F.nullif("text", F.lit(""))), fresh), "\n")).drop("_regions")


def align(pages: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, page, start, reason): where each page's text stands in its document (from 0); reason if it is missing, not unique, or not after the
    page before."""
    joined = pages.select(key, "page", F.col("text").alias("_page")).join(documents.select(key, F.col("text").alias("_text")), key, "left")
    at = F.coalesce(F.instr(F.col("_text"), F.col("_page")), F.lit(0))
    again = F.call_function("locate", F.col("_page"), F.col("_text"), at + 1)
    placed = joined.select(key, "page", F.when((F.length("_page") > 0) & (at > 0), at - 1).alias("start"), F.length("_page").alias("_n"), (again > 0).alias("_again"))
    before = F.max(F.col("start") + F.col("_n")).over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(F.col("start").isNull(), "missing").when(F.col("_again"), "not_unique").when(F.col("start") < before, "out_of_order").otherwise("")
    return placed.select(key, "page", "start", reason.alias("reason"))


def response_fields(responses: DataFrame, schema: str, key: str, body: str = "body") -> DataFrame:
    """The fields array of stored JSON responses as rows; responses that cannot be read give none."""
    return responses.select(key, F.from_json(body, f"fields array<struct<{schema}>>").alias("_r")).select(key, F.inline("_r.fields"))


def adapted(old: DataFrame, new: DataFrame, known_types: list[str]) -> DataFrame:
    """Both schemas as one: skipped becomes needs_review, unknown types otro, each with a warning; columns that one lacks are null."""
    skipped, odd = F.col("status") == "skipped", ~F.coalesce(F.col("document_type").isin(known_types), F.lit(False))
    notes = F.concat_ws(",", F.when(skipped, "skipped_mapped_to_needs_review"), F.when(odd, "document_type_mapped_to_otro"))
    made = old.withColumns({"warnings": notes, "status": F.when(skipped, "needs_review").otherwise(F.col("status")), "document_type": F.when(odd, "otro").otherwise(F.col("document_type"))})
    return made.unionByName(new, allowMissingColumns=True)


def catalogue(found: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows of both; of those with the same key the ledger's."""
    return ledger.unionByName(found.join(ledger.select(key), key, "left_anti"))


def call_plan(documents: DataFrame, labels: DataFrame, schemas: DataFrame, key: str) -> DataFrame:
    """(key, label, schema_id, stops): classify, parse and extract in order; extract only where the label has a schema."""
    joined = documents.select(key).join(labels, key, "left").join(schemas, "label", "left")
    return joined.select(key, "label", "schema_id", F.concat_ws(">", F.lit("classify"), F.lit("parse"), F.when(F.col("schema_id").isNotNull(), "extract")).alias("stops"))


def artifact_counts(artifacts: DataFrame, key: str) -> DataFrame:
    """Per document of artifacts(kind, warnings array): tables, forms, and the sorted distinct warnings."""
    per = artifacts.groupBy(key).agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "form").alias("forms"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings")))).alias("warnings"))
    return per.withColumn("warnings", F.array_join("warnings", ","))


def release_gate(members: DataFrame, release: str, stages: list[str]) -> DataFrame:
    """(release, n, reason) of members(revision_id, stage, outcome): blocked if any stage failed, incomplete if a revision lacks a stage."""
    per = members.groupBy(release, "revision_id").agg(F.countDistinct(F.when(F.col("stage").isin(stages) & (F.col("outcome") != "failed"), F.col("stage"))).alias("k"), F.bool_or(F.col("outcome") == "failed").alias("bad"))
    return per.groupBy(release).agg(F.count("*").alias("n"), F.when(F.bool_or("bad"), "blocked").when(F.min("k") < len(stages), "incomplete").otherwise("").alias("reason"))


def html_tables(docs: DataFrame, *, key: str, html: str = "html") -> DataFrame:
    """(key, table, row, header, cells) of all tables, inner ones of their own; a row is a header if all its cells are th. HTML is parsed row by row
    with the standard library, since nesting is beyond expressions."""
    from html.parser import HTMLParser

    import pyarrow as pa

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.n, self.open, self.rows = 0, [], []

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.open.append({"table": self.n, "row": -1, "cells": None, "cell": None})
                self.n += 1
            elif self.open:
                t = self.open[-1]
                if tag == "tr":
                    self.end_row(t)
                    t["cells"], t["row"] = [], t["row"] + 1
                elif tag in ("td", "th") and t["cells"] is not None:
                    t["cell"] = [tag, ""]
                    t["cells"].append(t["cell"])

        def handle_data(self, data):
            if self.open and self.open[-1]["cell"]:
                self.open[-1]["cell"][1] += data

        def handle_endtag(self, tag):
            if not self.open:
                return
            if tag in ("td", "th"):
                self.open[-1]["cell"] = None
            elif tag in ("tr", "table"):
                self.end_row(self.open[-1])
                if tag == "table":
                    self.open.pop()

        def end_row(self, t):
            if t["cells"]:
                self.rows.append((t["table"], t["row"], all(k == "th" for k, _ in t["cells"]), [" ".join(x.split()) for _, x in t["cells"]]))
            t["cells"] = t["cell"] = None

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader()
                reader.feed(text or "")
                reader.close()
                while reader.open:
                    reader.handle_endtag("table")
                out += [(k, *row) for row in reader.rows]
            kinds = (batch.column(0).type, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [key, "table", "row", "header", "cells"])

    return docs.where(F.col(html).contains("<table")).select(key, html).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, table int, row int, header boolean, cells array<string>")


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def write_checked(df: DataFrame, path: str, key: str) -> None:
    """Rows and, written last, the digest of each: a folder without finished digests is no bundle."""
    df.write.parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    stored.select(key, row_digest(stored.columns).alias("digest")).write.parquet(f"{path}/digests")


def damaged(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys whose row is missing, new or not the one that was written."""
    rows, digests = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/digests")
    now = rows.select(key, row_digest(rows.columns).alias("now"))
    return now.join(digests, key, "full_outer").where("not now <=> digest").select(key)
