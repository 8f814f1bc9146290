"""Queries of ids, manifests, reports, pages of lists, sidecars and runtime profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import ids
from evidara.operators import checks as K
from evidara.operators import platform as M
from evidara.operators import platforms as P
from evidara.plans.registry import query, table, texts

_ID = "'%s' || left(sha256(%s), %d)"


def _fenced(prefix, fields, length=32):
    return _ID % (prefix, " || chr(31) || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields), length)


@query(f"""
SELECT doc_id, {_fenced('sdoc_', ['source', 'doc_id'])} AS project_document_id, {_fenced('srev_', ['source', 'doc_id', 'n_chars'])} AS revision_id, {_fenced('pnode_', ['source', 'lang', 'doc_id'])} AS node_id,
  {_fenced('ndoc_', ['source', 'doc_id', 'lang'])} AS normalized_id, {_fenced('ebun_', ['doc_id', 'lang', 'n_chars'], 64)} AS bundle_id, {_fenced('rprof_', ['lang', 'source'], 64)} AS profile_id, {_fenced('rchk_', ["'readiness'", 'doc_id', 'sha256(text)'], 64)} AS check_id FROM documents
""")
def content_ids(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", ids.project_document_id("source", "doc_id").alias("project_document_id"), ids.revision_id("source", "doc_id", "n_chars").alias("revision_id"), ids.node_id("source", "lang", "doc_id").alias("node_id"),
        ids.normalized_document_id("source", "doc_id", "lang").alias("normalized_id"), ids.embedding_bundle_id("doc_id", "lang", "n_chars").alias("bundle_id"), ids.retrieval_profile_id("lang", "source").alias("profile_id"),
        ids.readiness_check_id(F.lit("readiness"), "doc_id", F.sha2("text", 256)).alias("check_id"),
    )


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber - 1 AS o, sha256(l_partkey || chr(31) || l_suppkey || chr(31) || coalesce(l_returnflag, '')) AS d FROM lineitem)
SELECT l_orderkey, sha256(string_agg(d, chr(10) ORDER BY o, d)) AS manifest_hash, count(*) AS n_members, min(o) = 0 AND max(o) = count(*) - 1 AND count(DISTINCT o) = count(*) AS dense FROM m GROUP BY l_orderkey
""")
def release_manifests(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("ordinal", F.col("l_linenumber") - 1)
    return P.manifests(rows, ["l_orderkey"], "ordinal", ["l_partkey", "l_suppkey", "l_returnflag"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return K.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT l_orderkey AS release_id, l_returnflag AS stage, count(*) FILTER (l_partkey % 3 = 0) AS reused, count(*) FILTER (l_partkey % 3 = 1) AS built, count(*) FILTER (l_partkey % 3 = 2) AS failed FROM lineitem GROUP BY GROUPING SETS ((l_orderkey, l_returnflag), (l_orderkey))
""")
def build_report(spark, sf_dir):
    p = F.col("l_partkey") % 3
    return P.build_report(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("release_id"), F.col("l_returnflag").alias("stage"), F.when(p == 0, "reused").when(p == 1, "built").otherwise("failed").alias("outcome")), "release_id")


@query("SELECT * FROM (SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 40)")
def customer_page(spark, sf_dir):
    rows, total = P.page(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], offset=40)
    return rows.crossJoin(total)  # one row


@query("SELECT o_orderkey, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def exists_flag(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return P.with_flag(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, ["o_custkey"], "known").select("o_orderkey", "known")


@query("""
SELECT 'src/' || doc_id || '.md' AS relpath, CASE WHEN doc_id % 2 = 0 THEN 'src/' || doc_id || '.metadata.json' END AS metadata, CASE WHEN doc_id % 3 = 0 THEN 'src/' || doc_id || '.pages.json' END AS pages FROM documents
""")
def sidecar_join(spark, sf_dir):
    d = F.col("doc_id")
    path = lambda suffix: F.concat(F.lit("src/"), d.cast("string"), F.lit(suffix))
    files = table(spark, sf_dir, "documents").select(F.explode(F.array_compact(F.array(path(".md"), F.when(d % 2 == 0, path(".metadata.json")), F.when(d % 3 == 0, path(".pages.json"))))).alias("relpath"))
    return P.with_sidecars(files, {"metadata": ".metadata.json", "pages": ".pages.json"})


@query("""
SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 9 <> 0 THEN CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN 'v1' WHEN c_custkey % 4 = 1 AND c_custkey % 5 = 0 THEN 'v2' WHEN c_custkey % 4 = 3 AND c_custkey % 5 <> 0 THEN 'v1' END END AS policy,
  CASE WHEN c_custkey % 9 = 0 THEN 'fingerprint_mismatch' WHEN NOT ((c_custkey % 4 IN (0, 3) AND c_custkey % 5 <> 0) OR (c_custkey % 4 = 1 AND c_custkey % 5 = 0)) THEN 'unsupported_recipe' ELSE '' END AS reason FROM customer
""")
def runtime_profiles(spark, sf_dir):
    k = F.col("c_custkey")
    strategy = F.when(k % 4 == 0, "structural").when(k % 4 == 1, "local-structural-v2").when(k % 4 == 2, "other").otherwise("local_structural_v1")
    context = F.when(k % 5 == 0, True).when(k % 5 == 1, False)
    return P.runtime_profiles(table(spark, sf_dir, "customer").select(k.alias("profile_id"), strategy.alias("strategy"), context.alias("include_section_context"), F.when(k % 9 == 0, "x").otherwise("f").alias("fingerprint"), F.lit("f").alias("expected_fingerprint")))


@query("SELECT r_regionkey || '|' || n_name || '|small' AS cell_id, CAST(r_regionkey AS VARCHAR) AS binding_id, n_name AS processing, 'small' AS chunking FROM region CROSS JOIN nation")
def parsed_cells(spark, sf_dir):
    made = M.variant_matrix(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("binding_id")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("processing")), spark.createDataFrame([("small",)], "chunking string"))
    return M.parse_cell(made.select("cell_id")).select("cell_id", "binding_id", "processing", "chunking")


@query("""
WITH s AS (SELECT o_custkey AS bundle_id, o_orderkey AS node_id, o_orderkey % 3 = 0 AS is_active, 'old' AS v FROM orders), n AS (SELECT o_custkey AS bundle_id, CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey ELSE o_orderkey END AS node_id FROM orders)
SELECT s.bundle_id, s.node_id, s.is_active, CASE WHEN n.node_id IS NULL THEN 'old' ELSE 'new' END AS v FROM s LEFT JOIN n ON n.node_id = s.node_id AND n.bundle_id = s.bundle_id
UNION ALL SELECT n.bundle_id, n.node_id, FALSE, 'new' FROM n WHERE n.node_id < 0
""")
def append_inactive(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), k.alias("node_id"), (k % 3 == 0).alias("is_active"))
    new = rows.select("bundle_id", F.when(F.col("node_id") % 4 == 0, -F.col("node_id")).otherwise(F.col("node_id")).alias("node_id"), F.lit("new").alias("v"))
    return P.append_inactive(rows.withColumn("v", F.lit("old")), new, ["bundle_id", "node_id"])


@query("""
SELECT doc_id AS node_id, CASE WHEN doc_id % 10 = 0 THEN 'root' WHEN doc_id % 10 < 8 THEN 'child' ELSE 'refused' END AS part FROM documents
""")
def parents_first(spark, sf_dir):
    d = F.col("doc_id")
    parent = F.when(d % 10 == 0, None).when(d % 10 < 8, d - d % 10).otherwise(-1)
    parts = P.parents_first(table(spark, sf_dir, "documents").select(d.alias("node_id"), parent.alias("parent_node_id")))
    named = [df.select("node_id", F.lit(name).alias("part")) for name, df in zip(("root", "child", "refused"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/' || doc_id ELSE '/other/' || doc_id END AS path FROM documents")
def relative_paths(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("C:\\root\\a\\"), d)).otherwise(F.concat(F.lit("/other/"), d))
    return table(spark, sf_dir, "documents").select("doc_id", P.relative(path, "C:\\root\\").alias("path"))


@query("SELECT vec_id AS node_id, label, CAST(label * 0.5 AS DOUBLE) AS score, CAST(vec_id % 7 AS DOUBLE) AS original_score FROM embeddings")
def reranked(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label", (F.col("vec_id") % 7).cast("double").alias("score"))
    return P.rerank(hits, F.col("label") * 0.5)


@query("SELECT event_id, round_even(CAST(value AS DOUBLE) * 100, 1) AS percent, greatest(0, CAST(round_even((value - 5) * 1000, 0) AS BIGINT)) AS ms FROM events WHERE value IS NOT NULL")
def rounded_measures(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", P.percent(F.col("value")).alias("percent"), P.duration_ms(F.col("value") - 5).alias("ms"))
