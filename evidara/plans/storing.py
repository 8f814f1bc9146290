"""Queries of document artifacts, maps and text repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import maps as P
from evidara.functions import text as T
from evidara.operators import artifacts as A
from evidara.plans.registry import query, table, texts


@query("""
SELECT 'p' || o_orderkey AS node_id, NULL AS parent_node_id, 'parent' AS node_role, o_orderpriority AS text FROM orders
UNION ALL SELECT 'c' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'p' || l_orderkey, 'child', l_returnflag FROM lineitem
""")
def node_projection(spark, sf_dir):
    parent = F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("parent_id")
    line = F.concat(F.lit("c"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])).alias("node_id")
    children = table(spark, sf_dir, "lineitem").select(line, F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("parent_id"), F.col("l_returnflag").alias("text"))
    return A.nodes(table(spark, sf_dir, "orders").select(parent, F.col("o_orderpriority").alias("text")), children)


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def grouped_children(spark, sf_dir):
    return A.grouped(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("children", ">").alias("roles"), "n")


@query("""
SELECT conv_id, turn, role, CAST(CASE WHEN role = '' OR contains(min(text), role) THEN 0 ELSE 1 END AS INTEGER) AS added FROM conversations GROUP BY conv_id, turn, role
""")
def hybrid_pages(spark, sf_dir):
    """Pages with their own text and their role (twice) as regions: only a role that the page does not hold is new."""
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    keys = ["conv_id", "turn", "role"]
    regions = pages.select(*keys, F.posexplode(F.array("text", "role", "role")).alias("ordinal", "text"))
    return A.merge_regions(pages, regions, keys).select(*keys, "added")


@query("""
WITH p AS (SELECT doc_id, k AS page, CASE k WHEN 1 THEN substr(text, 11, 40) WHEN 2 THEN substr(text, 31, 40) ELSE ' ' END AS t, text FROM documents, unnest([1, 2, 3]) AS u(k)),
s AS (SELECT doc_id, page, t, CASE WHEN len(t) > 0 AND contains(text, t) THEN strpos(text, t) - 1 END AS start, text FROM p)
SELECT doc_id, page, start, CASE WHEN start IS NULL THEN 'missing' WHEN contains(substr(text, start + 2), t) THEN 'not_unique' WHEN start < max(start + len(t)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'out_of_order' ELSE '' END AS reason FROM s
""")
def page_alignment(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    parts = F.array(F.substring("text", 11, 40), F.substring("text", 31, 40), F.lit(" "))
    pages = docs.select("doc_id", F.posexplode(parts).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return A.align(pages, docs, "doc_id")


@query("SELECT event_id, 'score' AS name, value::VARCHAR AS value FROM (SELECT event_id, CAST(value * 100 AS BIGINT) AS value FROM events WHERE event_id % 5 <> 0) UNION ALL SELECT event_id, 'type', event_type FROM events WHERE event_id % 5 <> 0")
def response_mapping(spark, sf_dir):
    """Stored JSON responses; every fifth cannot be read."""
    e = table(spark, sf_dir, "events")
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    body = F.to_json(F.struct(F.array(field("score", F.round(F.col("value") * 100).cast("bigint")), field("type", F.col("event_type"))).alias("fields")))
    return A.response_fields(e.select("event_id", F.when(F.col("event_id") % 5 != 0, body).otherwise("{broken").alias("body")), "name string, value string", "event_id")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 2 = 0 THEN 'needs_review' ELSE 'processed' END AS status, CASE WHEN doc_id % 2 = 0 AND lang NOT IN ('en', 'es') THEN 'otro' ELSE lang END AS document_type,
  CASE WHEN doc_id % 2 = 0 THEN concat_ws(',', CASE WHEN doc_id % 4 = 0 THEN 'skipped_mapped_to_needs_review' END, CASE WHEN lang NOT IN ('en', 'es') THEN 'document_type_mapped_to_otro' END) END AS warnings, CASE WHEN doc_id % 2 = 1 THEN n_chars END AS n_chars
FROM documents WHERE lang IS NOT NULL
""")
def schema_adaptation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "skipped").otherwise("processed").alias("status"), F.col("lang").alias("document_type"))
    new = docs.where("doc_id % 2 = 1").select("doc_id", F.lit("processed").alias("status"), F.col("lang").alias("document_type"), "n_chars")
    return A.adapted(old, new, ["en", "es"])


@query("SELECT doc_id, CASE WHEN l.k IS NOT NULL THEN 'ledger' ELSE 'files' END AS origin FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS k FROM labels) l ON l.k = doc_id UNION ALL SELECT DISTINCT doc_id, 'ledger' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def catalogue_union(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.lit("files").alias("origin"))
    return A.catalogue(found, table(spark, sf_dir, "labels").select("doc_id", F.lit("ledger").alias("origin")).distinct(), "doc_id")


@query("""
SELECT d.doc_id, CASE WHEN d.doc_id % 5 <> 0 THEN lang END AS label, CASE WHEN d.doc_id % 5 <> 0 AND lang IN ('en', 'fr') THEN 's_' || lang END AS schema_id,
  CASE WHEN d.doc_id % 5 <> 0 AND lang IN ('en', 'fr') THEN 'classify>parse>extract' ELSE 'classify>parse' END AS stops FROM documents d
""")
def call_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = docs.where("doc_id % 5 <> 0").select("doc_id", F.col("lang").alias("label"))
    return A.call_plan(docs, labels, spark.createDataFrame([("en", "s_en"), ("fr", "s_fr")], "label string, schema_id string"), "doc_id")


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS tables, count(*) FILTER (l_returnflag = 'R') AS forms, string_agg(DISTINCT 'w' || l_linenumber, ',' ORDER BY 'w' || l_linenumber) AS warnings FROM lineitem GROUP BY l_orderkey")
def artifact_counts(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "R", "form").otherwise("text")
    return A.artifact_counts(table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind"), F.array(F.concat(F.lit("w"), F.col("l_linenumber").cast("string"))).alias("warnings")), "l_orderkey")


@query("""
WITH m AS (SELECT l_suppkey AS rel, l_orderkey AS rev, l_returnflag AS stage, CASE WHEN l_partkey % 400 = 0 THEN 'failed' ELSE 'built' END AS outcome FROM lineitem),
r AS (SELECT rel, rev, count(DISTINCT CASE WHEN stage IN ('A', 'N') AND outcome <> 'failed' THEN stage END) AS k, count(*) FILTER (outcome = 'failed') AS bad FROM m GROUP BY rel, rev)
SELECT rel AS release_id, count(*) AS n, CASE WHEN sum(bad) > 0 THEN 'blocked' WHEN min(k) < 2 THEN 'incomplete' ELSE '' END AS reason FROM r GROUP BY rel
""")
def release_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    members = rows.select(F.col("l_suppkey").alias("release_id"), F.col("l_orderkey").alias("revision_id"), F.col("l_returnflag").alias("stage"), F.when(F.col("l_partkey") % 400 == 0, "failed").otherwise("built").alias("outcome"))
    return A.release_gate(members, "release_id", ["A", "N"])


@query("""
SELECT c_custkey, '{"brand":"b' || c_nationkey % 3 || '","name":"' || c_name || '","nation":"' || c_nationkey || '"}' AS merged, sha256('{"name":"' || c_name || '","nation":"' || c_nationkey || '"}') AS fingerprint FROM customer
""")
def metadata_maps(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey").cast("string")
    left = F.create_map(F.lit("nation"), nation, F.lit("name"), F.lit("old"), F.lit("api_key"), F.lit("x"))
    right = F.create_map(F.lit("name"), F.col("c_name"), F.lit("brand"), F.concat(F.lit("b"), (F.col("c_nationkey") % 3).cast("string")))
    whole = P.without(P.merged(left, right), "key|secret")
    return c.select("c_custkey", P.canonical_json(whole).alias("merged"), P.fingerprint(P.without(whole, "brand")).alias("fingerprint"))


@query("""
SELECT doc_id, md5(regexp_replace(regexp_replace(lower(translate(coalesce(source, '') || ' ' || coalesce(lang, '') || ' Ñandú', 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug_md5,
  CASE WHEN lang = 'en' THEN source || chr(10) || 'x' ELSE 'x' END AS input, doc_id % 3 <> 0 AS safe, 'a.b/' || doc_id || '.metadata.json' AS sidecar
FROM documents
""")
def text_keys(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a/../"), d)).otherwise(F.concat(F.lit("a..b/"), d, F.lit(".pdf")))
    named = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.lit("Ñandú"))
    prefix = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.slug(named)).alias("slug_md5"), T.in_context(prefix, F.lit("x")).alias("input"), T.safe_path(path).alias("safe"), T.sidecar(F.concat(F.lit("a.b/"), d, F.lit(".pdf")), ".metadata.json").alias("sidecar")
    )


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def composed_text(spark, sf_dir):
    """Texts with every é taken apart are put together again, and those that were read as Latin-1 are repaired: SQL sees the texts as they are."""
    text = F.coalesce("text", F.lit(""))
    apart = T.compose(F.replace(text, F.lit("é"), F.lit("e\u0301")))
    wrong = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    repaired = F.when(F.col("doc_id") % 2 == 0, apart).otherwise(T.repair(wrong))
    return texts(spark, sf_dir).select("doc_id", F.sha2(repaired, 256).alias("text_sha256"))


@query("""
SELECT page_id, k - 1 AS "row", k = 1 AS header, CASE k WHEN 1 THEN 'Id|Url' ELSE page_id || '|' || len(url) END AS cells FROM pages, unnest([1, 2]) AS u(k)
""")
def html_tables(spark, sf_dir):
    """A table about each page, put before the page's own HTML."""
    top = F.concat(F.lit("<table><tr><th>Id</th><th> Url\n</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), F.length("url").cast("string"), F.lit("</td></tr></table>"), "html")
    return A.html_tables(texts(spark, sf_dir, "pages").select("page_id", top.alias("html")), key="page_id").select("page_id", "row", "header", F.array_join("cells", "|").alias("cells"))
