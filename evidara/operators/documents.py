"""Normalised documents as a whole: the tree's consistency, golden expectations, materialisations, preflight, stored parser responses, page text and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import lineage, matching
from evidara.operators.gates import golden
from evidara.operators.invariants import outcomes

FINAL = ("processed", "needs_review", "failed")
#: How a label before a blank, and an empty field, are written.
FORM_LABEL, FORM_CUES = r"[^:\n|*_]{2,60}:[ \t]*_{2,}", ("____", "[ ]", "( )")


def tree_issues(inventory: DataFrame, documents: DataFrame, metadata: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, issue) of inventory(document_id, content_hash, status), documents(document_id, source_hash, front map), metadata(document_id, page_count)
    and pages(document_id, page_number): what does not fit together. One outer join by document after each side is one row a document."""
    i = inventory.groupBy("document_id").agg(F.max("content_hash").alias("content_hash"), F.max("status").alias("status"), F.count("*").alias("i_n"))
    d = documents.groupBy("document_id").agg(F.max("source_hash").alias("source_hash"), F.max(F.col("front")["document_id"]).alias("named"), F.count("*").alias("d_n"))
    m = metadata.groupBy("document_id").agg(F.max("page_count").alias("page_count"), F.count("*").alias("m_n"))
    p = pages.groupBy("document_id").agg(F.count("*").alias("p_n"), F.min("page_number").alias("first"), F.max("page_number").alias("last"), F.countDistinct("page_number").alias("different"))
    rows = i.join(d, "document_id", "full_outer").join(m, "document_id", "full_outer").join(p, "document_id", "full_outer")
    have = lambda c: F.col(c).isNotNull()
    issues = {
        "duplicate_id": (F.coalesce("i_n", F.lit(0)) > 1) | (F.coalesce("d_n", F.lit(0)) > 1) | (F.coalesce("m_n", F.lit(0)) > 1),
        "not_in_inventory": have("d_n") & ~have("i_n"), "document_missing": have("i_n") & ~have("d_n") & F.col("status").isin("processed", "needs_review"), "metadata_missing": have("d_n") & ~have("m_n"), "metadata_orphan": have("m_n") & ~have("d_n"),
        "pages_orphan": have("p_n") & ~have("d_n"), "status_not_final": have("i_n") & ~F.coalesce(F.col("status").isin(*FINAL), F.lit(False)), "hash_differs": have("d_n") & have("i_n") & ~F.col("source_hash").eqNullSafe(F.col("content_hash")),
        "page_count_differs": have("d_n") & have("m_n") & (F.coalesce("p_n", F.lit(0)) != F.coalesce("page_count", F.lit(-1))), "pages_not_contiguous": have("p_n") & ~((F.col("first") == 1) & (F.col("last") == F.col("p_n")) & (F.col("different") == F.col("p_n"))),
        "front_matter_differs": have("d_n") & ~F.col("named").eqNullSafe(F.col("document_id").cast("string")),
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in issues.items()]))
    return rows.select("document_id", F.explode(named).alias("issue"))


def golden_documents(expected: DataFrame, documents: DataFrame, pages: DataFrame, fields: list[str]) -> DataFrame:
    """(document_id, field, expected, actual) of expected(document_id, fields, page_count, anchors array), documents(document_id, fields) and pages(document_id,
    page_number, text): fields that differ, anchors that no page holds (in normalised text), page counts that differ; a document that is not
    expected has the field unexpected."""
    found = golden(expected, documents, "document_id", fields)
    counts = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    n = expected.join(counts, "document_id", "left").where(~F.col("page_count").eqNullSafe(F.coalesce("n", F.lit(0))))
    found = found.unionByName(n.select("document_id", F.lit("page_count").alias("field"), F.col("page_count").cast("string").alias("expected"), F.coalesce("n", F.lit(0)).cast("string").alias("actual")))
    lost = matching.anchors(expected, pages).where("pages = 0")
    found = found.unionByName(lost.select("document_id", F.lit("anchor").alias("field"), F.col("anchor").alias("expected"), F.lit(None).cast("string").alias("actual")))
    extra = documents.select("document_id").distinct().join(expected.select("document_id"), "document_id", "left_anti")
    return found.unionByName(extra.select("document_id", F.lit("unexpected").alias("field"), F.lit(None).cast("string").alias("expected"), F.col("document_id").cast("string").alias("actual")))


def materialization_report(materializations: DataFrame, vectors: DataFrame) -> DataFrame:
    """(materialization_id, check, passed) of materializations(materialization_id, project_id, owner_id, n_vectors, dimension, distance_metric, bundle_metric, status, content_hash,
    sealed_hash) and vectors(materialization_id, node_id, size)."""
    sizes = vectors.groupBy("materialization_id").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("nodes"), F.min("size").alias("low"), F.max("size").alias("high"))
    rows = materializations.join(sizes, "materialization_id", "left")
    n = F.coalesce("n", F.lit(0))
    return outcomes(
        rows, "materialization_id", owned_by_project=F.col("project_id") == F.col("owner_id"), vector_count_matches=n == F.col("n_vectors"), one_vector_a_node=n == F.coalesce("nodes", F.lit(0)),
        dimension_matches=(n == 0) | ((F.col("low") == F.col("dimension")) & (F.col("high") == F.col("dimension"))), metric_matches=F.col("distance_metric") == F.col("bundle_metric"),
        sealed_is_unchanged=(F.col("status") != "sealed") | F.col("content_hash").eqNullSafe(F.col("sealed_hash")),
    )


def preflight(requests: DataFrame, variants: DataFrame, revisions: DataFrame) -> DataFrame:
    """(request_id, reason, revision_ids) of requests(request_id, project_id, variant_id, ordinal, revision_id), variants(variant_id, variant_project), revisions(revision_id,
    revision_project): revisions once each in order of their first place, unless the variant or a revision is not the project's."""
    n = lineage.parts(requests)
    rows = requests.repartition(n, "revision_id").join(variants, "variant_id", "left").join(revisions, "revision_id", "left")
    foreign = lambda c: ~F.col(c).eqNullSafe(F.col("project_id"))
    first = rows.groupBy("request_id", "revision_id").agg(F.min("ordinal").alias("o"), F.bool_or(foreign("variant_project")).alias("v"), F.bool_or(foreign("revision_project")).alias("r"))
    per = first.repartition(n, "request_id").groupBy("request_id").agg(F.bool_or("v").alias("v"), F.bool_or("r").alias("r"), F.array_sort(F.collect_list(F.struct("o", "revision_id"))).alias("m"))
    reason = F.when(F.col("v"), "variant_of_other_project").when(F.col("r"), "revision_of_other_project").otherwise("")
    return per.select("request_id", reason.alias("reason"), F.when(reason == "", F.transform("m", lambda x: x["revision_id"])).alias("revision_ids"))


PARSED = "pages array<struct<page_number:int,text:string,confidence:double,regions:array<struct<kind:string,text:string>>,tables:array<struct<rows:array<array<string>>>>>>"


def parsed_pages(responses: DataFrame, key: str, body: str = "body") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages, regions, tables, unreadable keys) of stored parser responses: pages(key, page_number, text, confidence), regions(key, page_number, ordinal, kind,
    text), tables(key, page_number, ordinal, markdown, n_rows)."""
    read = responses.select(key, F.from_json(body, PARSED, {"mode": "PERMISSIVE"}).alias("r"))
    found = read.select(key, F.inline("r.pages"))
    regions = found.select(key, "page_number", F.posexplode("regions").alias("ordinal", "x")).select(key, "page_number", "ordinal", "x.kind", "x.text")
    tables = found.select(key, "page_number", F.posexplode("tables").alias("ordinal", "x")).select(key, "page_number", "ordinal", render_table(F.col("x.rows")).alias("markdown"), F.size("x.rows").alias("n_rows"))
    return found.select(key, "page_number", "text", "confidence"), regions, tables, read.where("r.pages is null").select(key)


def render_table(rows: Column) -> Column:
    """Rows of cells as a markdown table, the first as header; short rows are filled up, and | and line ends in cells are escaped. Empty without rows."""
    width = F.aggregate(rows, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    cell = lambda c: F.replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    full = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(full(r)))
    rule = line(F.array_repeat(F.lit("---"), width.cast("int")))
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")).otherwise("")


def page_texts(blocks: DataFrame, keys: list[str], *, order: str = "ordinal", text: str = "text", removed: str = "removed") -> DataFrame:
    """(keys, text): the normalised text of every page's blocks in order, but those that were removed as boilerplate; a page without any is empty."""
    kept = F.when(~F.coalesce(removed, F.lit(False)), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    listed = F.array_sort(F.collect_list(kept))
    return blocks.groupBy(*keys).agg(T.normalize_text(F.array_join(F.transform(listed, lambda x: x["t"]), "\n")).alias("text"))


def form_regions(regions: DataFrame, titles: Column, *, text: str = "text") -> DataFrame:
    """Regions with ``form``: those that hold a known form title, two labels before blanks, or an empty field."""
    low = F.lower(text)
    titled = F.exists(titles, lambda t: (t != "") & F.contains(low, F.lower(t)))
    cues = F.lit(False)
    for cue in FORM_CUES:
        cues = cues | F.contains(F.col(text), F.lit(cue))
    return regions.withColumn("form", F.coalesce(titled, F.lit(False)) | (F.regexp_count(text, F.lit(FORM_LABEL)) >= 2) | cues)


def adapt_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of both schemas: old ones (document_id, page, text, ocr boolean) as new (document_id, page_number, text_raw, extraction_method, confidence, warnings array).
    Old pages are numbered from 0 if any of the document's is 0, which is a warning."""
    zero = F.min("page").over(Window.partitionBy("document_id")) == 0
    made = old.withColumn("_zero", zero).select(
        "document_id", (F.col("page") + F.col("_zero").cast("int")).alias("page_number"), F.col("text").alias("text_raw"), F.when(F.col("ocr"), "ocr").otherwise("digital").alias("extraction_method"), F.lit(None).cast("double").alias("confidence"),
        F.array_compact(F.array(F.when(F.col("_zero"), "pages_renumbered_from_zero"), F.lit("adapted_from_1_0"))).alias("warnings"),
    )
    return made.unionByName(new)


def target_mismatch(profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """(profile_id, target_id, issue) of profiles(profile_id, target_id, vector_table, metric) whose target(target_id, target_table, metrics array, active) is unknown, off,
    of another table or another metric."""
    rows = profiles.join(targets.withColumn("_known", F.lit(True)), "target_id", "left")
    issue = F.when(F.col("_known").isNull(), "target_missing").when(~F.col("active"), "target_inactive").when(F.col("target_table") != F.col("vector_table"), "table_mismatch").when(~F.array_contains("metrics", F.col("metric")), "metric_mismatch")
    return rows.select("profile_id", "target_id", issue.alias("issue")).where("issue is not null")
