"""Queries of predicates, backfills, updating joins, claims, reading order and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import retrieval as R
from evidara.operators import selection as S
from evidara.plans.registry import query, table, texts


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 5, 7))")
def optional_and_list_predicates(spark, sf_dir):
    """A given and an absent filter, a list of values and a list that is a frame."""
    rows = S.where_given(_orders(spark, sf_dir), o_orderstatus="F", o_orderpriority=None)
    scope = S.among(table(spark, sf_dir, "customer"), "c_nationkey", [3, 5, 7]).select("c_custkey")
    return S.among(rows, "o_custkey", scope).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def source_subset(spark, sf_dir):
    return S.only_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), ["src3", "src1", "src1", "absent"], "source")[0]


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Digital text' WHEN 'click' THEN 'OCR' ELSE coalesce(event_type, 'unknown') END AS label FROM events")
def method_labels(spark, sf_dir):
    return S.labelled(table(spark, sf_dir, "events"), "event_type", {"view": "Digital text", "click": "OCR"}, name="label", other="unknown").select("event_id", "label")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_concat(['own=' || p_partkey % 5], CASE WHEN p_partkey % 3 = 0 THEN ['name=node'] WHEN s_suppkey IS NOT NULL THEN ['name=' || s_name] ELSE [] END, CASE WHEN s_suppkey IS NOT NULL THEN ['nation=' || s_nationkey] ELSE [] END)), ',') AS entries
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey
""")
def node_metadata(spark, sf_dir):
    """Metadata of nodes over that of their documents, without the excluded key."""
    text = lambda c: F.col(c).cast("string")
    own = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("own"), (F.col("p_partkey") % 5).cast("string"), F.lit("name"), F.lit("node"))).otherwise(F.create_map(F.lit("own"), (F.col("p_partkey") % 5).cast("string")))
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("document_id"), own.alias("metadata"))
    documents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), text("s_nationkey"), F.lit("secret"), text("s_suppkey")).alias("metadata"))
    made = S.enrich(nodes, documents).withColumn("metadata", S.without_keys(F.col("metadata"), ["secret"]))
    return made.select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("entries"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 1 OR (doc_id % 3 <> 0 AND doc_id % 5 <> 0) THEN '' ELSE concat_ws(',', 'pdf_semantic_review_required', CASE WHEN doc_id % 3 = 0 THEN 'tables_not_evaluated' END, CASE WHEN doc_id % 5 = 0 THEN 'forms_not_evaluated' END) END AS reasons FROM documents
""")
def material_features(spark, sf_dir):
    d = F.col("doc_id")
    status = lambda n: F.when(d % n == 0, "not_evaluated").otherwise("detected")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 2 == 0, ".pdf").otherwise(".md").alias("extension"), status(3).alias("tables"), status(5).alias("forms"))
    return S.feature_reasons(rows, ["tables", "forms"]).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT l_orderkey, CASE WHEN bool_or(l_partkey % 7 = 0) THEN 'detected' WHEN bool_and(l_partkey % 5 <> 0) THEN 'not_detected' ELSE 'not_evaluated' END AS status FROM lineitem GROUP BY l_orderkey")
def artifact_observations(spark, sf_dir):
    p = F.col("l_partkey")
    return S.observed(table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(p % 7 == 0, "detected").when(p % 5 != 0, "not_detected").otherwise("not_evaluated").alias("status")), "l_orderkey")


@query("SELECT doc_id, n_chars > 800 AND doc_id % 4 <> 0 AS bulk FROM documents WHERE doc_id % 6 <> 0")
def intake_candidates(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 6 != 0, F.lit(1)).alias("normalized_at"), F.when(F.col("n_chars") > 800, "clean").otherwise("needs_review").alias("review_state"), (d % 4 == 0).alias("in_snapshot"))
    return S.selectable(rows).select("doc_id", "bulk")


@query("""
WITH p AS (SELECT s_suppkey AS profile_id, s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT c_custkey AS document_id, profile_id FROM customer JOIN p ON s_nationkey = c_nationkey WHERE NOT (c_custkey % 3 = 0 AND profile_id % 2 = 0)
""")
def profile_backfill(spark, sf_dir):
    """Customers of a nation with its active suppliers, but pairs that exist."""
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("nation"))
    profiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("profile_id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 4 != 0).alias("active"))
    existing = documents.join(profiles, "nation").where("document_id % 3 = 0 and profile_id % 2 = 0")
    return S.backfill(documents, profiles, existing, ["nation"]).select("document_id", "profile_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE c_name END AS target, CASE WHEN c_custkey IS NOT NULL THEN c_nationkey END AS version FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey")
def update_from_join(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("target"), F.lit(None).cast("bigint").alias("version"))
    source = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", F.col("c_name").alias("target"), F.col("c_nationkey").cast("bigint").alias("version"))
    return S.update_from(rows, source, ["c_custkey"], ["target", "version"], only_null=True).select("o_orderkey", "target", "version")


@query("""
SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'w1' END AS worker FROM orders
""")
def conditional_claim(spark, sf_dir):
    queue = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("timestamp").alias("claimed_at"))
    return S.claim(queue, queue.where("run_id % 3 = 0"), "w1", "2024-01-01")[0].select("run_id", "status", "worker")


@query("""
WITH b AS (SELECT c_custkey AS bundle_id, c_custkey // 2 AS fingerprint, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'legacy_unverified' ELSE 'sealed' END AS status FROM customer),
m AS (SELECT o.bundle_id AS old, min(n.bundle_id) AS new FROM b o JOIN b n ON n.fingerprint = o.fingerprint AND n.status <> 'legacy_unverified' WHERE o.status = 'legacy_unverified' GROUP BY 1)
SELECT o_orderkey, coalesce(new, o_custkey) AS bundle_id, b.bundle_id IS NOT NULL AND new IS NULL AS kept FROM orders LEFT JOIN m ON old = o_custkey LEFT JOIN b ON b.bundle_id = o_custkey
""")
def legacy_reconciliation(spark, sf_dir):
    k = F.col("c_custkey")
    bundles = table(spark, sf_dir, "customer").select(k.alias("bundle_id"), F.floor(k / 2).alias("fingerprint"), F.when((k % 2 == 0) & (k % 3 != 0), "legacy_unverified").otherwise("sealed").alias("status"))
    runs = _orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("bundle_id"), F.col("o_custkey").alias("before"))
    kept, moved = S.supersede_legacy(bundles, {"runs": runs})
    own = kept.select(F.col("bundle_id").alias("before"), F.lit(True).alias("kept"))
    return moved["runs"].join(own, "before", "left").select("o_orderkey", "bundle_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity % 4, l_suppkey % 3, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 4 END, l_partkey * 100000 + l_suppkey * 10 + l_linenumber) - 1 AS reading_order FROM lineitem
""")
def reading_order(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", "image").otherwise("other")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") % 4).alias("top"), (F.col("l_suppkey") % 3).alias("x0"), kind.alias("kind"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("position"))
    return S.reading_order(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reading_order")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def build_size_limit(spark, sf_dir):
    return S.over_limit(_orders(spark, sf_dir), "o_custkey", 12)


@query("SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'N')) AS allowed FROM lineitem GROUP BY l_orderkey")
def allowed_reasons_subset(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return per.select("l_orderkey", S.subset(F.col("flags"), ["A", "N"]).alias("allowed"))


@query("""
SELECT 'lang' AS dimension, lang AS key, max_by(lang || doc_id % 3, doc_id) AS label, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang
UNION ALL SELECT 'source', source, source, count(*) FROM documents WHERE source <> '' GROUP BY source
""")
def dimension_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("lang", (F.col("doc_id") % 3).cast("string")).alias("lang_label"), "source", F.lit(None).cast("string").alias("source_label"))
    return S.dimensions(rows, ["lang", "source"], order="doc_id")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE n_chars > 200) AS approved, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM labels) AS questions")
def indexing_overview(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return S.overview(documents=t("documents"), approved=t("documents").where("n_chars > 200"), vectors=t("embeddings"), questions=t("labels"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS members, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey")
def bundle_id_sets(spark, sf_dir):
    found = S.id_sets(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("member")), "l_orderkey", "member")
    return found.select("l_orderkey", F.array_join("members", ",").alias("members"), "n")


@query("""
SELECT 'customer' AS table_name, count(*) FILTER (c_custkey % 7 = 0) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FILTER (s_suppkey % 7 = 0) FROM supplier UNION ALL SELECT 'part', count(*) FILTER (p_partkey % 7 = 0) FROM part
""")
def blocker_counts(spark, sf_dir):
    key = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("k"))
    return S.blockers({"customer": key("customer", "c_custkey"), "supplier": key("supplier", "s_suppkey"), "part": key("part", "p_partkey")}, "k % 7 = 0")


@query("""
WITH l AS (SELECT 'lexical' AS source, l_suppkey AS rank, l_partkey AS node_id, l_orderkey % 4 AS q, min('l' || l_linenumber) AS text FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL
  UNION ALL SELECT 'vector', l_suppkey, l_partkey, l_orderkey % 4, min('v' || l_linenumber) FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
o AS (SELECT *, CASE source WHEN 'vector' THEN 1 ELSE 2 END AS place FROM l)
SELECT q, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, CASE WHEN min(place) < max(place) THEN 'vector,lexical' WHEN min(place) = 1 THEN 'vector' ELSE 'lexical' END AS sources, arg_min(text, [place, rank]) AS text FROM o GROUP BY q, node_id
""")
def fusion_with_payload(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    def ranked(source, rows, mark):
        per = rows.groupBy(F.col("l_suppkey").alias("rank"), F.col("l_partkey").alias("node_id"), (F.col("l_orderkey") % 4).alias("q")).agg(F.min(F.concat(F.lit(mark), F.col("l_linenumber").cast("string"))).alias("text"))
        return per.select(F.lit(source).alias("source"), "rank", "node_id", "q", "text")
    return S.fuse(ranked("vector", li.where("l_linenumber <= 3"), "v").unionByName(ranked("lexical", li.where("l_linenumber > 3"), "l")), ["vector", "lexical"], by=("q",))


_FOLD = f"replace(lower(translate(text, '{T.ACCENTED}', '{T.PLAIN}')), 'ß', 'ss')"


@query(f"""
WITH n AS (SELECT d.doc_id AS node_id, d.source, l.quality, list_filter(regexp_split_to_array({_FOLD}, '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id WHERE quality = 1)
SELECT node_id, source, round(len(list_intersect(list_distinct(w), ['of', 'the'])) / 2, 6) AS score FROM n WHERE len(list_intersect(list_distinct(w), ['of', 'the'])) > 0 ORDER BY score DESC, node_id LIMIT 25
""")
def lexical_approved_documents(spark, sf_dir):
    """Lexical search over the nodes of approved documents, with the document's columns."""
    approved = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").alias("node_id"))
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("node_id"), "text", "source")
    nodes = docs.join(approved, "node_id", "left_semi")
    return R.lexical_overlap(nodes, ["the", "of"], 25).join(docs.select("node_id", "source"), "node_id").select("node_id", "source", "score")
