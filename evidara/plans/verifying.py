"""Queries of invariants. Columns of the driver's tables stand in for bundles, profiles and chunks; some rows are made to break each rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidara.operators import invariants as I
from evidara.plans.registry import query, table


def _unpivot(cte: str, key: str, checks: dict[str, str]) -> str:
    return f'SELECT {key}, u.c AS "check", CASE u.c ' + " ".join(f"WHEN '{c}' THEN {x}" for c, x in checks.items()) + f" END AS passed FROM {cte} CROSS JOIN (VALUES " + ", ".join(f"('{c}')" for c in checks) + ") AS u(c)"


_BUNDLE = {
    "source_chunk_bundle_registered": "k % 17 <> 0", "source_content_fingerprint_matches": "k % 17 <> 0 AND k % 13 <> 0", "profile_verified": "k % 5 <> 4", "configuration_homogeneous": "k % 11 <> 0", "engine_semantics_match_profile": "k % 7 <> 0",
    "child_chunk_count_matches": "mapped = n", "vector_count_matches": "vectors = n AND counted = n", "dimension_matches": "short = 0", "no_duplicate_children": "TRUE", "no_missing_children": "mapped = n", "mapping_complete": "mapped = n",
    "content_hashes_match": "drifted = 0", "checksums_present": "k % 19 <> 0 AND bare = 0",
}


@query(f"""
WITH o AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderkey % 50 <> 3) AS mapped, count(*) FILTER (o_orderkey % 60 <> 9) AS vectors, count(*) FILTER (o_orderkey % 60 <> 9 AND o_orderkey % 80 = 11) AS short,
  count(*) FILTER (o_orderkey % 50 <> 3 AND o_orderkey % 70 = 5) AS drifted, count(*) FILTER (o_orderkey % 50 <> 3 AND o_orderkey % 90 = 7) AS bare FROM orders GROUP BY 1),
b AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(n, 0) + CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS counted, coalesce(mapped, 0) AS mapped, coalesce(vectors, 0) AS vectors, coalesce(short, 0) AS short, coalesce(drifted, 0) AS drifted, coalesce(bare, 0) AS bare
  FROM customer LEFT JOIN o ON o.c = c_custkey)
SELECT k AS bundle_id, "check", passed FROM ({_unpivot('b', 'k', _BUNDLE)})
""")
def bundle_report(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey"), "o_orderkey")
    sizes = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    semantics = {"provider": F.lit("local"), "model": F.lit("m"), "model_revision": F.lit("1"), "dimension": F.lit(8), "normalization": F.lit("l2"), "distance_metric": F.lit("cosine")}
    bundles = table(spark, sf_dir, "customer").join(sizes, "c_custkey", "left").select(
        k.alias("bundle_id"), k.alias("chunk_bundle_id"), (k % 5).alias("profile_id"), F.when(k % 13 == 0, "old").otherwise("now").alias("source_fingerprint"), F.when(k % 11 == 0, "x").otherwise("f").alias("configuration_fingerprint"),
        *[(F.when(k % 7 == 0, "other").otherwise(v) if c == "model" else v).alias(c) for c, v in semantics.items()], (F.coalesce("n", F.lit(0)) + F.when(k % 23 == 0, 1).otherwise(0)).alias("vector_count"), (k % 19 != 0).alias("has_checksums"),
    )
    profiles = spark.range(5).select(F.col("id").alias("profile_id"), F.lit("f").alias("expected_fingerprint"), (F.col("id") != 4).alias("can_embed"), *[v.alias(c) for c, v in semantics.items()])
    sources = table(spark, sf_dir, "customer").where(k % 17 != 0).select(k.alias("chunk_bundle_id"), F.lit("now").alias("content_fingerprint"))
    children = orders.select(F.col("o_custkey").alias("chunk_bundle_id"), o.alias("child_id"), F.md5(o.cast("string")).alias("content_hash"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    chunks = orders.withColumn("place", place).where(o % 50 != 3).select(
        F.col("o_custkey").alias("bundle_id"), o.alias("child_id"), F.col("place").alias("vector_offset"), F.when(o % 70 == 5, "x").otherwise(F.md5(o.cast("string"))).alias("content_hash"), F.when(o % 90 != 7, "c").alias("vector_checksum")
    )
    vectors = orders.where(o % 60 != 9).select(F.col("o_custkey").alias("bundle_id"), F.when(o % 80 == 11, 7).otherwise(8).alias("size"))
    return I.bundle_report(bundles, profiles, sources, children, chunks, vectors)


_ACTIVE = {
    "embedding_bundle_sealed": "k % 9 <> 0", "indexing_run_completed": "k % 14 <> 13 AND k % 8 <> 0 AND k % 6 <> 1", "indexing_target_compatible": "k % 3 <> 2 AND k % 3 = k % 2 AND k % 5 <> 0",
    "node_and_vector_counts_match": "k % 14 <> 13 AND k % 10 <> 0 AND k % 12 <> 0", "artifact_checksums_match": "k % 21 <> 0",
}


@query(f"SELECT bundle_id, CASE WHEN f = '' THEN 'passed' ELSE 'blocked' END AS status, f AS failed FROM (SELECT k AS bundle_id, coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (NOT passed), '') AS f FROM ({_unpivot('(SELECT o_orderkey AS k FROM orders)', 'k', _ACTIVE)}) GROUP BY k)")
def activation_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    bundles = orders.select(
        k.alias("bundle_id"), (k % 2).alias("profile_id"), (k % 3).alias("target_id"), F.when(k % 9 == 0, "writing").otherwise("sealed").alias("status"), F.lit(5).alias("vector_count"), F.when(k % 5 == 0, "l1").otherwise("cosine").alias("distance_metric"), (k % 21 != 0).alias("checksums_verified")
    )
    runs = orders.where(k % 14 != 13).select(
        k.alias("bundle_id"), F.when(k % 8 == 0, "failed").otherwise("completed").alias("run_status"), F.when(k % 6 == 1, "failed").otherwise("passed").alias("validation_status"), F.when(k % 10 == 0, 4).otherwise(5).alias("vector_rows"), F.when(k % 12 == 0, 6).otherwise(5).alias("child_nodes")
    )
    targets = spark.range(3).select(F.col("id").alias("target_id"), (F.col("id") != 2).alias("target_active"), name(F.col("id")).alias("target_table"), F.array(F.lit("cosine"), F.lit("l2")).alias("metrics"))
    profiles = spark.range(2).select(F.col("id").alias("profile_id"), name(F.col("id")).alias("vector_table"))
    return I.blocked(I.activation(bundles, runs, targets, profiles), "bundle_id")


_PROFILE = {
    "engine_resolved": "k % 6 <> 5", "provider_matches": "TRUE", "model_matches": "k % 4 <> 0", "dimension_matches": "k % 7 <> 0", "normalization_matches": "TRUE", "revision_matches": "CASE WHEN k % 6 < 3 THEN k % 5 <> 0 ELSE k % 8 <> 0 END", "target_metric_supported": "k % 9 <> 0",
    "fingerprint_matches": "k % 10 <> 0",
}


@query(f"SELECT k AS profile_id, \"check\", passed FROM ({_unpivot('(SELECT c_custkey AS k FROM customer)', 'k', _PROFILE)}) WHERE k % 6 <> 5 OR \"check\" IN ('engine_resolved', 'target_metric_supported', 'fingerprint_matches')")
def profile_verification(spark, sf_dir):
    return I.profile_report(*_profiles(spark, sf_dir))


@query("SELECT c_custkey AS profile_id, f AS field, CASE f WHEN 'model' THEN 'old' ELSE '9' END AS expected, CASE f WHEN 'model' THEN 'm' ELSE '8' END AS observed FROM customer CROSS JOIN (VALUES ('model'), ('dimension')) AS u(f) WHERE c_custkey % 6 <> 5 AND CASE f WHEN 'model' THEN c_custkey % 4 = 0 ELSE c_custkey % 7 = 0 END")
def engine_mismatches(spark, sf_dir):
    return I.mismatches(*_profiles(spark, sf_dir)[:2])


@query("SELECT CASE WHEN k % 6 < 3 THEN 'observed' WHEN k % 8 <> 0 THEN 'attested' ELSE 'unproven' END AS revision_source, count(*) AS n FROM (SELECT c_custkey AS k FROM customer) GROUP BY 1")
def revision_sources(spark, sf_dir):
    return I.revision_source(*_profiles(spark, sf_dir)[:2]).groupBy("revision_source").agg(F.count("*").alias("n"))


def _profiles(spark, sf_dir):
    k = F.col("c_custkey")
    profiles = table(spark, sf_dir, "customer").select(
        k.alias("profile_id"), (k % 6).alias("engine_id"), F.lit(1).alias("target_id"), F.lit("local").alias("provider"), F.when(k % 4 == 0, "old").otherwise("m").alias("model"), F.when(k % 7 == 0, 9).otherwise(8).alias("dimension"), F.lit("l2").alias("normalization"),
        F.when(k % 5 == 0, "2").otherwise("1").alias("model_revision"), F.when(k % 8 != 0, F.when(k % 5 == 0, "2").otherwise("1")).alias("attested_revision"), F.when(k % 9 == 0, "l1").otherwise("cosine").alias("distance_metric"), F.when(k % 10 == 0, "x").otherwise("f").alias("fingerprint"), F.lit("f").alias("expected_fingerprint"),
    )
    engines = spark.range(5).select(F.col("id").alias("engine_id"), F.lit("local").alias("provider"), F.lit("m").alias("model"), F.lit(8).alias("dimension"), F.lit("l2").alias("normalization"), F.when(F.col("id") < 3, "1").alias("revision"))
    return profiles, engines, spark.range(2).select(F.col("id").alias("target_id"), F.array(F.lit("cosine")).alias("metrics"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS i, min(l_suppkey) OVER w AS s, min(l_partkey) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)),
r AS (SELECT o_orderkey AS d, 'no_parents' AS rule, 1 AS n FROM orders WHERE o_orderkey % 31 = 0 UNION ALL SELECT o_orderkey, 'no_children', 1 FROM orders WHERE o_orderkey NOT IN (SELECT d FROM l)
  UNION ALL SELECT o_orderkey, 'parent_twice', 1 FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 29 = 0 UNION ALL SELECT o_orderkey, 'parent_profile', CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE 1 END FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 37 = 0
  UNION ALL SELECT d, 'child_profile', count(*) FROM l WHERE p % 100 = 0 GROUP BY d UNION ALL SELECT d, 'child_parent', count(*) FROM l WHERE d % 31 = 0 OR p % 90 = 1 GROUP BY d UNION ALL SELECT d, 'child_tokens', count(*) FROM l WHERE s % 50 + 410 > 450 GROUP BY d
  UNION ALL SELECT d, 'overlap_tokens', count(*) FROM l WHERE (p % 70 > 0 AND p % 70 NOT BETWEEN 5 AND 60) OR s % 75 > 60 GROUP BY d UNION ALL SELECT d, 'overlap_reasons', count(*) FROM l WHERE i = 4 GROUP BY d
  UNION ALL SELECT o_orderkey, 'parent_blocks', 1 FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 41 = 0)
SELECT d AS document_id, rule, CAST(n AS BIGINT) AS n FROM r
""")
def chunk_bundle_invariants(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    parent = lambda c: F.concat(F.lit("p"), c.cast("string"))
    parents = orders.where(k % 31 != 0).select(k.alias("document_id"), parent(k).alias("parent_id"), F.when(k % 37 == 0, "other").otherwise("std").alias("profile_id"), F.array(F.lit(1), F.when(k % 41 == 0, 3).otherwise(2)).alias("block_ids"))
    parents = parents.unionByName(parents.where("document_id % 29 = 0"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    d, p, s = F.col("l_orderkey"), F.col("p"), F.col("s")
    children = lines.select(
        d.alias("document_id"), F.col("l_linenumber").alias("child_id"), F.when(p % 90 == 1, "none").otherwise(parent(d)).alias("parent_id"), F.when(p % 100 == 0, "other").otherwise("std").alias("profile_id"), (s % 50 + 410).alias("token_count"), (p % 70).alias("overlap_previous"),
        F.when(s % 75 > 60, s % 75).otherwise(0).alias("overlap_next"), F.when(F.col("l_linenumber") == 4, F.array(F.lit("first"), F.lit("bad"))).otherwise(F.array(F.lit("first"))).alias("reasons"),
    )
    blocks = orders.select(k.alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("block_id"))
    return I.chunk_violations(orders.select(k.alias("document_id")), parents, children, I.Bounds("std", 450, 5, 60, ("first", "atomic")), blocks)


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id AS document_id, 'missing' AS rule FROM d WHERE doc_id % 25 = 0
UNION ALL SELECT doc_id, 'parent_count' FROM d WHERE doc_id % 25 <> 0 AND doc_id % 4 = 1 AND doc_id % 7 <> 3 UNION ALL SELECT doc_id, 'tables_present' FROM d WHERE doc_id % 25 <> 0 AND doc_id % 6 = 0
UNION ALL SELECT doc_id, 'child_count_min' FROM d WHERE doc_id % 25 <> 0 AND doc_id % 9 < 3 UNION ALL SELECT doc_id, 'reasons' FROM d WHERE doc_id % 25 <> 0 AND doc_id % 8 = 0
UNION ALL SELECT doc_id, 'literal:' || l FROM d CROSS JOIN (VALUES ('the'), ('zzqx')) AS u(l) WHERE doc_id % 25 <> 0 AND NOT contains(t, l)
""")
def chunk_golden_contract(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    expected = docs.select(d.alias("document_id"), F.when(d % 7 != 3, 2).alias("parent_count"), F.lit(3).alias("child_least"), F.lit(False).alias("tables_present"), lit("start").alias("required_reasons"), lit("the", "zzqx").alias("literals"))
    summaries = docs.where(d % 25 != 0).select(d.alias("document_id"), F.when(d % 4 == 1, 1).otherwise(2).alias("parent_count"), (d % 9).alias("child_count"), (d % 6 == 0).alias("tables_present"), F.when(d % 8 == 0, lit("end")).otherwise(lit("start", "end")).alias("reasons"))
    return I.golden_contract(expected, summaries, docs.select(d.alias("document_id"), "text"), exact=["parent_count", "tables_present"], least={"child_count": "child_least"})


@query("""
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 10 <> o_custkey % 3 AND o_orderkey % 10 <> 9 THEN 'processing_of_other_project' WHEN o_orderkey % 10 = 9 THEN 'processing_of_other_project' WHEN o_orderkey % 4 = 3 THEN 'chunking_of_other_project'
  WHEN o_orderkey % 10 = 2 AND o_orderkey % 3 <> 0 THEN 'unverifiable_revision' WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'incompatible_binding' WHEN o_orderkey % 13 = 0 THEN 'recipe_already_active' ELSE '' END AS reason FROM orders
""")
def variant_creation_gates(spark, sf_dir):
    k, project = F.col("o_orderkey"), F.col("o_custkey") % 3
    orders = table(spark, sf_dir, "orders")
    requests = orders.select(
        k.alias("request_id"), project.alias("project_id"), (k % 10).alias("processing_id"), F.when(k % 4 == 3, -1).otherwise(project).alias("chunking_id"), F.lit(1).alias("version"), F.when(k % 7 == 0, "none").otherwise("b").alias("binding_key"), F.when(k % 11 == 0, 2).otherwise(1).alias("embedding_profile_id"), (k % 3 == 0).alias("allow_unverifiable"), (k % 13).alias("recipe"),
    )
    processing = spark.range(9).select(F.col("id").alias("processing_id"), F.col("id").alias("project"), F.when(F.col("id") == 2, "unverifiable").otherwise("verified").alias("status"))
    chunking = spark.range(-1, 3).select(F.col("id").alias("chunking_id"), F.col("id").alias("project"))
    three = spark.range(3).select(F.col("id").alias("project_id"))
    bindings = three.select("project_id", F.lit(1).alias("version"), F.lit("b").alias("binding_key"), F.lit(1).alias("bound_profile_id"))
    return I.variant_gates(requests, processing, chunking, bindings, three.select("project_id", F.lit(0).cast("bigint").alias("recipe")))
