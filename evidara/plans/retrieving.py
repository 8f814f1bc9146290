"""Retrieval queries: embeddings are the vectors, documents the nodes (same id), a document's source its parent."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import vectors as V
from evidara.operators import retrieval as R
from evidara.plans.registry import query, table, texts

#: The query vector of single searches is that of vec_id 0.
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_VECTORS = "SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS v, label, vec_id % 3 AS lane FROM embeddings"
_WORDS = "list_filter(regexp_split_to_array(replace(lower(translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')), 'ß', 'ss'), '[^a-z0-9]+'), lambda x: x <> '')"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label", (F.col("vec_id") % 3).alias("lane"))


def asked(spark, sf_dir):
    """One row: the query vector."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def scored(spark, sf_dir, metric):
    rows = vectors(spark, sf_dir).crossJoin(F.broadcast(asked(spark, sf_dir)))
    return rows.withColumn("score", F.round(V.score(F.col("embedding"), F.col("q"), metric), 6))


@query(f"""
WITH n AS (SELECT doc_id AS node_id, source, lang, n_chars, CASE WHEN n_chars > 200 THEN 'processed' ELSE 'needs_review' END AS status FROM documents),
hits AS (
  SELECT v.node_id, n.source AS parent_id, n.status, n.n_chars, round(list_cosine_similarity(v.v, {_Q}), 6) AS score
  FROM ({_VECTORS}) v JOIN n USING (node_id) WHERE v.lane = 0 AND n.status = 'processed' ORDER BY score DESC, node_id LIMIT 10
), parents AS (SELECT source AS parent_id, count(*) AS parent_docs, min(doc_id) AS parent_first FROM documents GROUP BY source)
SELECT node_id, parent_id, score, parent_docs, parent_first, score < 0.5 AS low_confidence FROM hits LEFT JOIN parents USING (parent_id)
""")
def evidence_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select(F.col("doc_id").alias("node_id"), F.col("source").alias("parent_id"), F.when(F.col("n_chars") > 200, "processed").otherwise("needs_review").alias("processing_status"))
    hits = scored(spark, sf_dir, "cosine").where("lane = 0").join(nodes.where("processing_status = 'processed'"), "node_id")
    best = hits.select("node_id", "parent_id", "score", "processing_status").orderBy(F.desc("score"), "node_id").limit(10)
    parents = docs.groupBy(F.col("source").alias("parent_id")).agg(F.count("*").alias("parent_docs"), F.min("doc_id").alias("parent_first"))
    return best.join(parents, "parent_id", "left").select("node_id", "parent_id", "score", "parent_docs", "parent_first", (F.col("score") < 0.5).alias("low_confidence"))


@query(f"SELECT node_id, label, round(list_cosine_similarity(v, {_Q}), 6) AS score FROM ({_VECTORS}) WHERE lane = 0 ORDER BY score DESC, node_id LIMIT 20")
def vector_topk_cosine(spark, sf_dir):
    return scored(spark, sf_dir, "cosine").where("lane = 0").select("node_id", "label", "score").orderBy(F.desc("score"), "node_id").limit(20)


@query(f"SELECT node_id, round(1 - list_distance(v, {_Q}), 6) AS l2_score, round(1 + list_inner_product(v, {_Q}), 6) AS ip_score FROM ({_VECTORS})")
def vector_score_l2_ip(spark, sf_dir):
    return scored(spark, sf_dir, "l2").select("node_id", F.col("score").alias("l2_score"), F.round(V.score(F.col("embedding"), F.col("q"), "inner_product"), 6).alias("ip_score"))


@query(f"""
WITH q AS (SELECT node_id AS query_id, v AS qv FROM ({_VECTORS}) WHERE node_id % 50 = 0),
s AS (SELECT query_id, node_id, round(list_cosine_similarity(v, qv), 6) AS score FROM ({_VECTORS}) JOIN q ON node_id <> query_id)
SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 5
""")
def batch_search_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    queries = rows.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.batch_topk(queries, rows, 5)


@query(f"SELECT node_id, round(list_cosine_similarity(v, {_Q}), 6) AS score FROM ({_VECTORS}) WHERE label = 3 AND lane = 1 ORDER BY score DESC, node_id LIMIT 10")
def metadata_filtered_search(spark, sf_dir):
    rows = scored(spark, sf_dir, "cosine").withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("lane"), F.col("lane").cast("string")))
    return R.with_metadata(rows, {"label": "3", "lane": "1"}).select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(10)


@query(f"""
SELECT node_id, score FROM (SELECT doc_id AS node_id, round(len(list_intersect(list_distinct({_WORDS}), ['and', 'la', 'of', 'the', 'und'])) / 5, 6) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, node_id LIMIT 25
""")
def lexical_overlap(spark, sf_dir):
    nodes = texts(spark, sf_dir).select(F.col("doc_id").alias("node_id"), "text")
    return R.lexical_overlap(nodes, ["the", "of", "and", "la", "und"], 25).select("node_id", "score")


@query(f"""
WITH w AS (SELECT doc_id AS node_id, {_WORDS} AS words FROM documents),
h AS (SELECT node_id, len(words) AS n, len(list_filter(words, lambda x: x = 'the')) AS a, len(list_filter(words, lambda x: x = 'with')) AS b FROM w)
SELECT node_id, round((a + b) / (1 + ln(CAST(n AS DOUBLE))), 6) AS score FROM h WHERE a > 0 AND b > 0 ORDER BY score DESC, node_id LIMIT 25
""")
def lexical_all_terms_rank(spark, sf_dir):
    nodes = texts(spark, sf_dir).select(F.col("doc_id").alias("node_id"), "text")
    return R.lexical_all_terms(nodes, ["the", "with"], 25).select("node_id", "score")


@query(f"""
WITH a AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM (SELECT node_id, round(list_cosine_similarity(v, {_Q}), 6) AS score FROM ({_VECTORS}) ORDER BY score DESC, node_id LIMIT 50)),
w AS (SELECT doc_id AS node_id, round(len(list_intersect(list_distinct({_WORDS}), ['of', 'the'])) / 2, 6) AS score FROM documents),
b AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM (SELECT * FROM w WHERE score > 0 ORDER BY score DESC, node_id LIMIT 50)),
u AS (SELECT 'vector' AS source, * FROM a UNION ALL SELECT 'lexical', * FROM b)
SELECT node_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY node_id
""")
def hybrid_rrf(spark, sf_dir):
    from pyspark.sql import Window

    best = Window.orderBy(F.desc("score"), "node_id")  # over the 50 rows of a top-k
    a = scored(spark, sf_dir, "cosine").select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(50)
    b = R.lexical_overlap(texts(spark, sf_dir).select(F.col("doc_id").alias("node_id"), "text"), ["the", "of"], 50).select("node_id", "score")
    ranked = [x.withColumn("rank", F.row_number().over(best)).select(F.lit(s).alias("source"), "node_id", "rank") for s, x in (("vector", a), ("lexical", b))]
    return R.rrf(ranked[0].unionByName(ranked[1]))


@query("""
SELECT c_custkey AS profile_id, mode, CASE mode WHEN 'vector' THEN 'ready' ELSE 'failed' END AS runtime_status FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0 THEN 'blocked' WHEN c_custkey % 2 = 0 THEN 'vector' WHEN c_custkey % 3 = 0 THEN 'blocked' ELSE 'lexical' END AS mode FROM customer)
""")
def policy_search_fallback(spark, sf_dir):
    k = F.col("c_custkey")
    status, fallback = F.when(k % 11 == 0, "unproven").otherwise("compatible"), F.when(k % 3 == 0, "never").when(k % 3 == 1, "always").otherwise("allowed_when_vector_unavailable")
    profiles = table(spark, sf_dir, "customer").select(k.alias("profile_id"), (k % 7 != 0).alias("active"), (k % 5 != 0).alias("query_enabled"), status.alias("compatibility_status"), (k % 2 == 0).alias("embedding_ok"), fallback.alias("fallback_policy"))
    return R.policy(profiles).select("profile_id", "mode", "runtime_status")


_HITS = "SELECT doc_id AS node_id, doc_id // 10 * 10 AS parent_node_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 7 END AS page_number, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS section FROM documents"
_PARENTS = "SELECT doc_id AS parent_node_id, source AS parent_text, CAST(99 AS BIGINT) AS parent_page, 'all' AS parent_section FROM documents WHERE doc_id % 10 = 0 AND doc_id % 30 <> 0"


def _leaves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leaves = docs.select(
        F.col("doc_id").alias("node_id"), (F.col("doc_id") - F.col("doc_id") % 10).alias("parent_node_id"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 7).alias("page_number"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("section"),
    )
    parents = docs.where("doc_id % 10 = 0 and doc_id % 30 <> 0").select(F.col("doc_id").alias("node_id"), F.col("source").alias("text"), F.lit(99).cast("bigint").alias("page_number"), F.lit("all").alias("section"))
    return leaves, parents


@query(f"SELECT node_id, h.parent_node_id, coalesce(page_number, parent_page) AS page_number, coalesce(nullif(section, ''), parent_section) AS section, parent_text FROM ({_HITS}) h LEFT JOIN ({_PARENTS}) p ON h.parent_node_id = p.parent_node_id")
def parent_expansion_left(spark, sf_dir):
    return R.expand_parents(*_leaves(spark, sf_dir)).select("node_id", "parent_node_id", "page_number", "section", "parent_text")


@query(f"SELECT node_id, h.parent_node_id, coalesce(page_number, parent_page) AS page_number, coalesce(nullif(section, ''), parent_section) AS section, parent_text FROM ({_HITS}) h JOIN ({_PARENTS}) p ON h.parent_node_id = p.parent_node_id")
def parent_expansion_inner(spark, sf_dir):
    return R.expand_parents(*_leaves(spark, sf_dir), keep_orphans=False).select("node_id", "parent_node_id", "page_number", "section", "parent_text")


@query(f"SELECT node_id, score, label AS page_start, label AS page_end, score < 0.5 AS low_confidence, lane <> 0 AS needs_review FROM (SELECT *, round(list_cosine_similarity(v, {_Q}), 6) AS score FROM ({_VECTORS}))")
def evidence_projection(spark, sf_dir):
    hits = scored(spark, sf_dir, "cosine").withColumn("page_number", F.col("label")).withColumn("processing_status", F.when(F.col("lane") == 0, "processed").otherwise("needs_review"))
    return R.evidence(hits).select("node_id", "score", "page_start", "page_end", "low_confidence", "needs_review")


@query(f"""
WITH q AS (SELECT node_id AS query_id, v AS qv, label AS ql FROM ({_VECTORS}) WHERE node_id % 20 = 0),
s AS (SELECT query_id, ql, node_id, label, round(list_cosine_similarity(v, qv), 6) AS score FROM ({_VECTORS}) JOIN q ON node_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s),
f AS (SELECT query_id, min(CASE WHEN label = ql THEN rank END) AS first FROM r WHERE rank <= 10 GROUP BY query_id)
SELECT round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f
""")
def recall_mrr(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    queries = rows.where("node_id % 20 = 0")
    ranked = R.batch_topk(queries.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query")), rows, 10)
    # of the rows that were found, those with the query's label are relevant
    label = lambda name: rows.select(F.col("node_id").alias(name), F.col("label").alias(f"{name}_label"))
    relevant = ranked.select("query_id", F.col("node_id").alias("relevant_id")).join(label("query_id"), "query_id").join(label("relevant_id"), "relevant_id").where("query_id_label = relevant_id_label").select("query_id", "relevant_id")
    return R.hit_rates(ranked, relevant, 3)


@query("SELECT doc_id, list_transform(range(8), lambda i: CAST(CAST('0x' || substr(sha256(i || ':' || text), 1, 2) AS INTEGER) AS DOUBLE) / 255)[3] AS third, sha256(text) AS text_sha256 FROM documents")
def hash_embedding(spark, sf_dir):
    made = V.hash_embedding(F.col("text"), 8)
    return texts(spark, sf_dir).select("doc_id", made[2].alias("third"), F.sha2("text", 256).alias("text_sha256"))
