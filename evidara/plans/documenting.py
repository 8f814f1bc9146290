"""Queries of document trees, golden documents, materialisations, preflights, parser responses, page text and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import documents as D
from evidara.plans.registry import query, table, texts


@query("""
WITH d AS (SELECT doc_id, n_chars, doc_id % 11 <> 0 AS inv, doc_id % 13 <> 0 AS doc, doc_id % 7 <> 0 AS meta, doc_id % 5 = 0 AS gap, doc_id % 3 + 1 AS n FROM documents),
i AS (SELECT doc_id, u.x AS issue, CASE u.x WHEN 'duplicate_id' THEN (doc_id % 17 = 0 AND inv) WHEN 'not_in_inventory' THEN doc AND NOT inv WHEN 'document_missing' THEN inv AND NOT doc AND doc_id % 6 <> 1 AND doc_id % 6 <> 2 WHEN 'metadata_missing' THEN doc AND NOT meta WHEN 'metadata_orphan' THEN meta AND NOT doc
  WHEN 'pages_orphan' THEN NOT doc WHEN 'status_not_final' THEN inv AND doc_id % 6 = 1 WHEN 'hash_differs' THEN inv AND doc AND doc_id % 19 = 0 WHEN 'page_count_differs' THEN doc AND meta AND doc_id % 23 = 0 WHEN 'pages_not_contiguous' THEN gap ELSE doc AND doc_id % 29 = 0 END AS bad
  FROM d CROSS JOIN (VALUES ('duplicate_id'), ('not_in_inventory'), ('document_missing'), ('metadata_missing'), ('metadata_orphan'), ('pages_orphan'), ('status_not_final'), ('hash_differs'), ('page_count_differs'), ('pages_not_contiguous'), ('front_matter_differs')) AS u(x))
SELECT doc_id AS document_id, issue FROM i WHERE bad
""")
def document_tree(spark, sf_dir):
    d = F.col("document_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    inventory = docs.where(d % 11 != 0).select("document_id", F.col("h").alias("content_hash"), F.when(d % 6 == 1, "running").when(d % 6 == 2, "failed").otherwise("processed").alias("status"))
    inventory = inventory.unionByName(inventory.where(d % 17 == 0))
    bodies = docs.where(d % 13 != 0).select("document_id", F.when(d % 19 == 0, "x").otherwise(F.col("h")).alias("source_hash"), F.create_map(F.lit("document_id"), F.when(d % 29 == 0, "0x").otherwise(d.cast("string"))).alias("front"))
    n = (d % 3 + 1).cast("int")
    metadata = docs.where(d % 7 != 0).select("document_id", F.when(d % 23 == 0, 99).otherwise(n).alias("page_count"))
    pages = docs.select("document_id", F.explode(F.sequence(F.lit(1), n)).alias("k")).select("document_id", F.when(d % 5 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("page_number"))
    return D.tree_issues(inventory, bodies, metadata, pages)


@query("""
WITH e AS (SELECT * FROM documents WHERE doc_id % 9 <> 0), a AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE source END AS source FROM documents WHERE doc_id % 8 <> 0)
SELECT e.doc_id AS document_id, 'lang' AS field, e.lang AS expected, a.lang AS actual FROM e LEFT JOIN a ON a.doc_id = e.doc_id WHERE e.lang IS DISTINCT FROM a.lang
UNION ALL SELECT e.doc_id, 'source', e.source, a.source FROM e LEFT JOIN a ON a.doc_id = e.doc_id WHERE e.source IS DISTINCT FROM a.source
UNION ALL SELECT doc_id, 'page_count', CASE WHEN doc_id % 10 = 0 THEN '3' ELSE '2' END, '2' FROM e WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, 'anchor', 'zz qx', NULL FROM e WHERE doc_id % 6 <> 0
UNION ALL SELECT doc_id, 'unexpected', NULL, CAST(doc_id AS VARCHAR) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM e)
""")
def golden_documents(spark, sf_dir):
    d = F.col("document_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    expected = docs.where(d % 9 != 0).select("document_id", "lang", "source", F.when(d % 10 == 0, 3).otherwise(2).alias("page_count"), F.array(F.lit("zz qx"), F.lit("Página 2")).alias("anchors"))
    pages = docs.select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_number")).select("document_id", "page_number", F.concat(F.lit("Página  "), F.col("page_number").cast("string"), F.when(d % 6 == 0, " zz\t qx").otherwise("")).alias("text"))
    return D.golden_documents(expected, docs.where(d % 8 != 0).withColumn("source", F.when(d % 4 == 0, "x").otherwise(F.col("source"))), pages, ["lang", "source"])


_MATERIAL = {"owned_by_project": "k % 7 <> 0", "vector_count_matches": "n = counted", "one_vector_a_node": "n = nodes", "dimension_matches": "k % 5 <> 0 OR n = 0", "metric_matches": "k % 9 <> 0", "sealed_is_unchanged": "k % 2 = 0 OR k % 6 <> 3"}


@query("""
WITH v AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT o_orderkey % 1000) AS nodes FROM orders GROUP BY 1), m AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(nodes, 0) AS nodes, coalesce(n, 0) + CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS counted FROM customer LEFT JOIN v ON v.k = c_custkey)
SELECT k AS materialization_id, u.c AS "check", CASE u.c """ + " ".join(f"WHEN '{c}' THEN {x}" for c, x in _MATERIAL.items()) + " END AS passed FROM m CROSS JOIN (VALUES " + ", ".join(f"('{c}')" for c in _MATERIAL) + ") AS u(c)")
def materialization_report(spark, sf_dir):
    k = F.col("c_custkey")
    orders = table(spark, sf_dir, "orders")
    sizes = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(sizes, "c_custkey", "left").select(
        k.alias("materialization_id"), F.lit(1).alias("project_id"), F.when(k % 7 == 0, 2).otherwise(1).alias("owner_id"), (F.coalesce("n", F.lit(0)) + F.when(k % 8 == 0, 1).otherwise(0)).alias("n_vectors"), F.when(k % 5 == 0, 9).otherwise(8).alias("dimension"), F.lit("cosine").alias("distance_metric"),
        F.when(k % 9 == 0, "l2").otherwise("cosine").alias("bundle_metric"), F.when(k % 2 == 1, "sealed").otherwise("writing").alias("status"), F.when(k % 6 == 3, "new").otherwise("h").alias("content_hash"), F.lit("h").alias("sealed_hash"),
    )
    return D.materialization_report(rows, orders.select(F.col("o_custkey").alias("materialization_id"), (F.col("o_orderkey") % 1000).alias("node_id"), F.lit(8).alias("size")))


@query("""
WITH r AS (SELECT l_orderkey AS q, l_suppkey AS v, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2),
p AS (SELECT q, CASE WHEN q % 10 = 0 THEN 'variant_of_other_project' WHEN bool_or(v % 50 = 0) THEN 'revision_of_other_project' ELSE '' END AS reason, string_agg(CAST(v AS VARCHAR), ',' ORDER BY o, v) AS ids FROM r GROUP BY q)
SELECT q AS request_id, reason, CASE WHEN reason = '' THEN ids END AS revision_ids FROM p
""")
def normalization_preflight(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.lit(1).alias("project_id"), (F.col("l_orderkey") % 10).alias("variant_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("revision_id"))
    variants = spark.range(10).select(F.col("id").alias("variant_id"), F.when(F.col("id") == 0, 2).otherwise(1).alias("variant_project"))
    revisions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("revision_id")).distinct().withColumn("revision_project", F.when(F.col("revision_id") % 50 == 0, 2).otherwise(1))
    return D.preflight(requests, variants, revisions).withColumn("revision_ids", F.array_join("revision_ids", ","))


def _responses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cell = lambda c: F.concat(F.lit("a|"), c.cast("string"))
    page = F.struct(
        F.lit(1).alias("page_number"), F.col("event_type").alias("text"), F.lit(0.5).alias("confidence"), F.array(F.struct(F.lit("title").alias("kind"), F.col("event_type").alias("text")), F.struct(F.lit("body").alias("kind"), F.lit("x").alias("text"))).alias("regions"),
        F.array(F.struct(F.array(F.array(F.lit("Id"), F.lit("Kind\nname")), F.array(cell(F.col("event_id")))).alias("rows"))).alias("tables"),
    )
    return e.select("event_id", F.when(F.col("event_id") % 6 != 0, F.to_json(F.struct(F.array(page).alias("pages")))).otherwise("{broken").alias("body"))


@query("SELECT event_id, 1 AS page_number, event_type AS text, CAST(0.5 AS DOUBLE) AS confidence FROM events WHERE event_id % 6 <> 0")
def parsed_pages(spark, sf_dir):
    return D.parsed_pages(_responses(spark, sf_dir), "event_id")[0]


@query("SELECT event_id, 1 AS page_number, u.o AS ordinal, CASE u.o WHEN 0 THEN 'title' ELSE 'body' END AS kind, CASE u.o WHEN 0 THEN event_type ELSE 'x' END AS text FROM events CROSS JOIN (VALUES (0), (1)) AS u(o) WHERE event_id % 6 <> 0")
def parsed_regions(spark, sf_dir):
    return D.parsed_pages(_responses(spark, sf_dir), "event_id")[1]


@query(r"SELECT event_id, 1 AS page_number, 0 AS ordinal, '| Id | Kind name |' || chr(10) || '| --- | --- |' || chr(10) || '| a\|' || event_id || ' |  |' AS markdown, 2 AS n_rows FROM events WHERE event_id % 6 <> 0")
def parsed_tables(spark, sf_dir):
    return D.parsed_pages(_responses(spark, sf_dir), "event_id")[2]


@query("SELECT event_id FROM events WHERE event_id % 6 = 0")
def unreadable_responses(spark, sf_dir):
    return D.parsed_pages(_responses(spark, sf_dir), "event_id")[3]


@query("""
SELECT l_orderkey, coalesce(string_agg('p' || l_partkey || ' x', chr(10) ORDER BY l_linenumber, 'p' || l_partkey || '  x') FILTER (l_partkey % 4 <> 0), '') AS text FROM lineitem GROUP BY l_orderkey
""")
def page_text(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("  x")).alias("text"), (F.col("l_partkey") % 4 == 0).alias("removed"))
    return D.page_texts(rows, ["l_orderkey"])


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 2) AS form FROM orders")
def form_regions(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "Ver FORMATO A aquí").when(k % 5 == 1, "Nombre: __ Cargo: ___").when(k % 5 == 2, "sí [ ] no").when(k % 5 == 3, "Nombre: __ nada").otherwise(F.col("o_orderpriority"))
    return D.form_regions(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), F.array(F.lit("formato a"), F.lit(""))).select("o_orderkey", "form")


@query("""
SELECT l_orderkey AS document_id, l_linenumber - CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_orderkey % 2 = 0 AND m = 1 THEN 1 ELSE 0 END AS page_number, CASE WHEN l_suppkey % 2 = 0 THEN 'ocr' ELSE 'digital' END AS extraction_method,
  CASE WHEN l_orderkey % 2 = 0 AND m = 1 THEN 'pages_renumbered_from_zero,adapted_from_1_0' ELSE 'adapted_from_1_0' END AS warnings FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_orderkey % 3 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, 'digital', '' FROM lineitem WHERE l_orderkey % 3 = 0
""")
def page_schema_adaptation(spark, sf_dir):
    k = F.col("l_orderkey")
    li = table(spark, sf_dir, "lineitem")
    old = li.where(k % 3 != 0).select(k.alias("document_id"), (F.col("l_linenumber") - F.when(k % 2 == 0, 1).otherwise(0)).alias("page"), F.lit("t").alias("text"), (F.col("l_suppkey") % 2 == 0).alias("ocr"))
    new = li.where(k % 3 == 0).select(k.alias("document_id"), F.col("l_linenumber").alias("page_number"), F.lit("t").alias("text_raw"), F.lit("digital").alias("extraction_method"), F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("warnings"))
    return D.adapt_pages(old, new).select("document_id", "page_number", "extraction_method", F.array_join("warnings", ",").alias("warnings"))


@query("""
SELECT c_custkey AS profile_id, c_custkey % 5 AS target_id, CASE WHEN c_custkey % 5 = 4 THEN 'target_missing' WHEN c_custkey % 5 = 3 THEN 'target_inactive' WHEN c_custkey % 2 = 1 THEN 'table_mismatch' ELSE 'metric_mismatch' END AS issue FROM customer
WHERE c_custkey % 5 >= 3 OR c_custkey % 2 = 1 OR c_custkey % 7 = 0
""")
def target_mismatches(spark, sf_dir):
    k = F.col("c_custkey")
    profiles = table(spark, sf_dir, "customer").select(k.alias("profile_id"), (k % 5).alias("target_id"), F.when(k % 2 == 1, "other").otherwise("t").alias("vector_table"), F.when(k % 7 == 0, "l1").otherwise("l2").alias("metric"))
    targets = spark.range(4).select(F.col("id").alias("target_id"), F.lit("t").alias("target_table"), F.array(F.lit("l2")).alias("metrics"), (F.col("id") != 3).alias("active"))
    return D.target_mismatch(profiles, targets)
