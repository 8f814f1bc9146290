"""Queries of gates, precedence, ownership and snapshot comparison. Columns of the driver's tables stand in for platform columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import gates as G
from evidara.plans.registry import query, table, texts


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""
SELECT l_orderkey * 10 + l_linenumber AS row_id, rule FROM lineitem, unnest(['discount', 'quantity', 'shipped']) AS u(rule)
WHERE CASE rule WHEN 'discount' THEN l_discount > 0.08 WHEN 'quantity' THEN l_quantity < 2 ELSE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1998-01-01' END
""")
def check_constraints(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    shipped = (F.col("l_linestatus") != "O") | (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    return G.violations(rows, "row_id", discount=F.col("l_discount") <= 0.08, quantity=F.col("l_quantity") >= 2, shipped=shipped)


@query("""
WITH v AS (SELECT label AS p, vec_id % 4 AS t, vec_id % 40 AS d, vec_id // 100 AS b, vec_id % 4 < 3 AS is_active FROM embeddings),
c AS (SELECT p, t, count(*) AS n, count(DISTINCT d) AS docs, count(DISTINCT b) AS nb, min(b) AS b FROM v WHERE is_active GROUP BY p, t),
r AS (SELECT c_custkey AS retrieval_id, c_custkey % 7 <> 0 AS active, CASE WHEN c_nationkey % 5 = 0 THEN 'failed' WHEN c_nationkey % 5 = 1 THEN NULL ELSE 'passed' END AS validation, c_custkey % 12 AS p, c_custkey % 5 AS t FROM customer)
SELECT retrieval_id, coalesce(n, 0) AS active_rows, coalesce(docs, 0) AS active_documents, CASE WHEN nb = 1 THEN b END AS bundle_id, x = '' AS ready, x AS blocking_reasons FROM (
  SELECT *, concat_ws(',', CASE WHEN r.p >= 10 OR r.p % 3 = 0 THEN 'EMBEDDING_PROFILE_COMPATIBILITY_NOT_PROVEN' END, CASE WHEN r.t = 4 OR r.p >= 10 OR r.t % 2 <> r.p % 2 THEN 'INDEXING_TARGET_INCOMPATIBLE' END,
    CASE WHEN r.t < 4 AND n IS NULL THEN 'NO_ACTIVE_VECTOR_ROWS' END, CASE WHEN NOT active THEN 'RETRIEVAL_PROFILE_BLOCKED' END, CASE WHEN validation IS NULL OR validation <> 'passed' THEN 'RETRIEVAL_PROFILE_NOT_VALIDATED' END) AS x
  FROM r LEFT JOIN c ON c.p = r.p AND c.t = r.t)
""")
def retrieval_readiness(spark, sf_dir):
    v = F.col("vec_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("profile_id"), (v % 4).alias("target_id"), (v % 40).alias("document_id"), F.floor(v / 100).alias("bundle_id"), (v % 4 < 3).alias("is_active"))
    c, nation = F.col("c_custkey"), F.col("c_nationkey") % 5
    status = F.when(nation == 0, "failed").when(nation > 1, "passed")
    retrieval = table(spark, sf_dir, "customer").select(c.alias("retrieval_id"), (c % 7 != 0).alias("active"), status.alias("validation"), (c % 12).alias("profile_id"), (c % 5).alias("target_id"))
    profiles = spark.range(10).select(F.col("id").alias("profile_id"), _text("t", F.col("id") % 2).alias("vector_table"), F.lit("cosine").alias("metric"), (F.col("id") % 3 != 0).alias("queryable"))
    targets = spark.range(4).select(F.col("id").alias("target_id"), _text("t", F.col("id") % 2).alias("target_table"), F.array(F.lit("cosine"), F.lit("l2")).alias("metrics"))
    return G.retrieval_readiness(retrieval, profiles, targets, vectors)


@query("""
WITH d AS (SELECT o_custkey AS run_id, CAST(o_orderkey AS VARCHAR) AS document_id, CASE o_orderkey % 30 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'done' END AS status, 'E' || o_orderkey % 3 AS error_code FROM orders)
SELECT * FROM d WHERE status <> 'done'
UNION ALL SELECT c_custkey, '', 'failed', 'RUN' FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 4 <> 0 AND c_custkey NOT IN (SELECT run_id FROM d WHERE status <> 'done')
""")
def run_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    documents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), k.cast("string").alias("document_id"), F.when(k % 30 == 0, "failed").when(k % 30 == 1, "skipped").otherwise("done").alias("status"), _text("E", k % 3).alias("error_code"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_nationkey") % 2 == 0, "failed").otherwise("completed").alias("status"), F.when(F.col("c_custkey") % 4 != 0, "RUN").alias("error_code"))
    return G.run_errors(runs, documents)


@query("""
WITH p AS (SELECT user_id % 500 AS d, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'inventory' WHEN doc_id % 5 = 0 THEN 'metadata' WHEN m IS NOT NULL THEN 'page_confidence_average' ELSE 'unavailable' END AS kind,
  round(CASE WHEN doc_id % 3 = 0 THEN 0.9 WHEN doc_id % 5 = 0 THEN 0.8 ELSE m END, 6) AS value
FROM documents LEFT JOIN p ON d = doc_id
""")
def confidence_precedence(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 3 == 0, 0.9).alias("inventory"), F.when(d % 5 == 0, 0.8).alias("metadata"))
    pages = table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("doc_id"), F.col("value").alias("confidence"))
    return G.first_measured(docs, pages, ["inventory", "metadata"], key="doc_id").withColumn("value", F.round("value", 6))


@query("""
SELECT o_orderkey, CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 2 = 0 AND s_nationkey > 4 THEN s_name ELSE o_orderpriority END AS value, CASE WHEN s_suppkey % 2 = 0 AND s_nationkey > 4 THEN 'remote' ELSE 'local' END AS source
FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey
""")
def remote_reconciliation(spark, sf_dir):
    local = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("value"))
    remote = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_name").alias("value"), (F.col("s_suppkey") % 2 == 0).alias("supported"), F.when(F.col("s_nationkey") > 4, "seen").otherwise("").alias("evidence"))
    return G.reconcile(local, remote, keys=["o_orderkey"])


@query("SELECT l.doc_id, 'rev' || d.doc_id AS revision_id FROM labels l LEFT JOIN (SELECT * FROM documents WHERE n_chars > 300) d ON d.doc_id = l.doc_id")
def identity_attachment(spark, sf_dir):
    revisions = table(spark, sf_dir, "documents").where("n_chars > 300").select("doc_id", _text("rev", F.col("doc_id")).alias("revision_id"), F.col("source").alias("project_id"))
    found, without = G.attach_identity(table(spark, sf_dir, "labels").select("doc_id"), revisions, key="doc_id")
    return found.select("doc_id", "revision_id").unionByName(without.select("doc_id", F.lit(None).cast("string").alias("revision_id")))


@query("""
SELECT * FROM (SELECT 'no_lang' AS issue, count(*) AS row_count FROM documents WHERE lang IS NULL UNION ALL SELECT 'short_documents', count(*) FROM documents WHERE n_chars < 200
UNION ALL SELECT 'debts', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no_region', count(*) FROM nation WHERE n_regionkey IS NULL) WHERE row_count > 0
""")
def issue_counts(spark, sf_dir):
    t = lambda name, where: table(spark, sf_dir, name).where(where)
    return G.issue_counts(no_lang=t("documents", "lang is null"), short_documents=t("documents", "n_chars < 200"), debts=t("customer", "c_acctbal < 0"), no_region=t("nation", "n_regionkey is null"))


@query("""
WITH r AS (SELECT o_custkey AS g, o_orderkey AS ordinal, o_orderkey % 4 <> 0 AS readable, CASE WHEN o_orderkey % 6 = 1 THEN 'p' || o_orderkey % 5 END AS project_id FROM orders),
f AS (SELECT g, project_id, row_number() OVER (PARTITION BY g ORDER BY ordinal) AS k FROM r WHERE readable AND project_id IS NOT NULL)
SELECT x.g AS o_custkey, CASE WHEN f.g IS NOT NULL THEN 'platform' WHEN unread > 0 THEN 'unverifiable' ELSE 'legacy' END AS ownership, f.project_id
FROM (SELECT g, count(*) FILTER (NOT readable) AS unread FROM r GROUP BY g) x LEFT JOIN f ON f.g = x.g AND k = 1
""")
def ownership_classification(spark, sf_dir):
    k = F.col("o_orderkey")
    return G.ownership(table(spark, sf_dir, "orders").select("o_custkey", k.alias("ordinal"), (k % 4 != 0).alias("readable"), F.when(k % 6 == 1, _text("p", k % 5)).alias("project_id")), "o_custkey")


@query("""
SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 10 = 4 THEN 'removed' WHEN doc_id % 10 = 5 AND text IS NOT NULL THEN 'changed' END AS change FROM documents) WHERE change IS NOT NULL
""")
def snapshot_changes(spark, sf_dir):
    d = F.col("doc_id")
    hashed = texts(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"))
    after = hashed.where(d % 10 != 4).withColumn("sha", F.when(d % 10 == 5, F.reverse("sha")).otherwise(F.col("sha")))
    return G.changes(hashed.where(d % 10 != 3), after, "doc_id", "sha")


_CALLS = "SELECT event_id // 4 AS run, event_id AS position, CASE event_type WHEN 'view' THEN 'parse' WHEN 'click' THEN 'extract' ELSE 'classify' END AS stop FROM events"


@query(f"""
WITH c AS ({_CALLS}), p AS (SELECT run, string_agg(stop, ' ' ORDER BY position) AS s FROM c GROUP BY run)
SELECT run, CASE WHEN len(s) - len(replace(s, 'parse', 'pars')) <> 1 THEN 'not_one_parse' WHEN s LIKE '%extract%extract%' OR s LIKE '%classify%classify%' THEN 'repeated' WHEN s LIKE '%extract%parse%' THEN 'extract_before_parse' WHEN s LIKE '%extract%classify%' THEN 'classify_after_extract' ELSE '' END AS reason FROM p
""")
def call_order_validity(spark, sf_dir):
    stop = F.when(F.col("event_type") == "view", "parse").when(F.col("event_type") == "click", "extract").otherwise("classify")
    return G.call_order(table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("run"), F.col("event_id").alias("position"), stop.alias("stop")), "run")


@query("""
WITH a AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 9 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 50 <> 7)
SELECT d.doc_id, f AS field, CASE f WHEN 'lang' THEN d.lang WHEN 'source' THEN d.source ELSE CAST(d.n_chars AS VARCHAR) END AS expected, CASE f WHEN 'lang' THEN a.lang WHEN 'source' THEN a.source ELSE CAST(a.n_chars AS VARCHAR) END AS actual
FROM documents d CROSS JOIN (VALUES ('lang'), ('source'), ('n_chars')) AS u(f) LEFT JOIN a ON a.doc_id = d.doc_id
WHERE CASE f WHEN 'lang' THEN d.lang IS DISTINCT FROM a.lang WHEN 'source' THEN d.source IS DISTINCT FROM a.source ELSE d.n_chars IS DISTINCT FROM a.n_chars END
""")
def golden_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    d = F.col("doc_id")
    # a changed number, and ids that are not the expected ones
    actual = docs.withColumn("n_chars", F.when(d % 9 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))).withColumn("doc_id", F.when(d % 50 == 7, -d).otherwise(d))
    return G.golden(docs, actual, "doc_id", ["lang", "source", "n_chars"])


_TITLES = ("Gu\u00eda de uso.", "Pol\u00edtica  SST", "Acta :", "Norma")


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey % 4 AS k, o_orderkey % 3 AS c FROM orders)
SELECT o_orderkey, f AS field, CASE f WHEN 'title' THEN ['{"', '".join(_TITLES)}'][k + 1] ELSE 'PR-SST-0' || c END AS expected, CASE f WHEN 'title' THEN 'Norma' ELSE 'pr sst 01' END AS actual
FROM o CROSS JOIN (VALUES ('title'), ('document_code')) AS u(f) WHERE CASE f WHEN 'title' THEN k <> 3 AND NOT (o_orderkey % 2 = 0) ELSE c <> 1 END
""")
def golden_folded(spark, sf_dir):
    """Titles that differ in accents, misread letters, blanks and end marks, and codes in their separators, are equal; every second order has its own title in another spelling."""
    k, o = F.col("o_custkey") % 4, F.col("o_orderkey")
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), k.cast("int"))
    spelt = ("GUIA DE  USO", "Pol\u00c3\u00adtica SST", "acta", "norma.")
    rows = table(spark, sf_dir, "orders").select(o, pick(_TITLES).alias("title"), F.concat(F.lit("PR-SST-0"), (o % 3).cast("string")).alias("document_code"), pick(spelt).alias("other"))
    actual = rows.select(o, F.when(o % 2 == 0, F.col("other")).otherwise("Norma").alias("title"), F.lit("pr sst 01").alias("document_code"))
    return G.golden(rows, actual, "o_orderkey", ["title", "document_code"], lambda value, field: T.golden_value(value, field)).select("o_orderkey", "field", "expected", F.when(F.col("field") == "title", "Norma").otherwise(F.col("actual")).alias("actual"))


@query("SELECT c_custkey AS profile_id, min(CASE WHEN s_suppkey % 3 = c_custkey % 4 AND (c_nationkey % 2 = 0 OR s_nationkey % 2 = 0) THEN s_suppkey END) AS target_id FROM customer LEFT JOIN supplier ON s_suppkey % 3 = c_custkey % 4 GROUP BY c_custkey")
def target_provisioning(spark, sf_dir):
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), _text("t", F.col("c_custkey") % 4).alias("vector_table"), F.when(F.col("c_nationkey") % 2 == 0, "cosine").otherwise("l2").alias("metric"))
    metrics = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("cosine"), F.lit("l2"))).otherwise(F.array(F.lit("cosine")))
    return G.provision(profiles, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), _text("t", F.col("s_suppkey") % 3).alias("target_table"), metrics.alias("metrics")))


@query("""
WITH c AS (SELECT l_orderkey AS d, l_linenumber AS position, l_suppkey % 3 + 1 AS page, l_partkey % 120 - 10 AS score, 't' || l_partkey AS text FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score < 100, CASE WHEN score >= 100 THEN page ELSE -score END, position, text) AS k FROM c WHERE score >= 100 OR (page = 1 AND score > 0))
SELECT d AS l_orderkey, text, page, score FROM r WHERE k = 1
""")
def best_title(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 3 + 1).alias("page"), (F.col("l_partkey") % 120 - 10).alias("score"), _text("t", F.col("l_partkey")).alias("text"))
    return G.best_title(rows, "l_orderkey")


@query("""
SELECT doc_id, name FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), (VALUES ('country', 'THE', ''), ('code', 'zzqx', 'and'), ('none', NULL, '')) AS f(name, value, evidence)
WHERE value IS NOT NULL AND NOT contains(t, lower(value)) AND NOT (evidence <> '' AND contains(t, evidence))
""")
def unsupported_fields(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    row = lambda name, value, evidence: F.struct(F.lit(name).alias("name"), F.lit(value).cast("string").alias("value"), F.array(F.lit(evidence)).alias("evidence"), F.lit(True).alias("critical"))
    fields = docs.select("doc_id", F.inline(F.array(row("country", "THE", ""), row("code", "zzqx", "and"), row("none", None, ""))))
    return G.unsupported_fields(fields, docs, lambda c: F.lower(c), key="doc_id")


@query("""
WITH b AS (SELECT o_custkey AS g, CAST(o_orderkey % 500 AS DOUBLE) AS x0, CAST(o_orderkey % 500 + o_orderkey % 3 AS DOUBLE) AS x1, CAST(792 - o_orderkey % 700 - o_orderkey % 5 AS DOUBLE) AS top, CAST(792 - o_orderkey % 700 AS DOUBLE) AS bottom, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderkey % 4 END AS page FROM orders)
SELECT g AS o_custkey, round(min(x0), 6) AS x0, round(min(top), 6) AS top, round(max(CASE WHEN x1 <= x0 THEN x0 + 0.01 ELSE x1 END), 6) AS x1, round(max(CASE WHEN bottom <= top THEN top + 0.01 ELSE bottom END), 6) AS bottom, min(page) AS page_start, max(page) AS page_end FROM b GROUP BY g HAVING count(page) = count(*)
UNION ALL SELECT g, NULL, NULL, NULL, NULL, NULL, NULL FROM b GROUP BY g HAVING count(page) < count(*)
""")
def union_boxes(spark, sf_dir):
    k, d = F.col("o_orderkey"), lambda c: c.cast("double")
    low = k % 700
    made = G.box(d(k % 500), d(k % 500 + k % 3), F.lit(None).cast("double"), F.lit(None).cast("double"), d(low), d(low + k % 5), F.lit(792.0))
    boxes = table(spark, sf_dir, "orders").select("o_custkey", made.alias("b"), F.when(k % 40 != 0, k % 4).alias("page")).select("o_custkey", "page", "b.*")
    return G.around(boxes, ["o_custkey"]).select("o_custkey", *[F.round(c, 6).alias(c) for c in ("x0", "top", "x1", "bottom")], "page_start", "page_end")


@query("SELECT concat_ws('/', lang, source, n_chars) AS path, count(DISTINCT doc_id) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS sources FROM (SELECT DISTINCT lang, source, n_chars, doc_id FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def path_collisions(spark, sf_dir):
    return G.collisions(table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", "n_chars").alias("path"), "doc_id"), "path", "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 11 = 0 THEN 'input_changed' WHEN o_orderkey % 7 = 0 THEN 'other_id' ELSE 'not_reused' END AS reason FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0")
def rerun_determinism(spark, sf_dir):
    k = F.col("o_orderkey")
    first = table(spark, sf_dir, "orders").select("o_orderkey", _text("b", k).alias("bundle_id"), F.md5(k.cast("string")).alias("input_hash"), F.lit(False).alias("reused"))
    again = first.where(k % 13 != 0).select("o_orderkey", F.when(k % 7 == 0, "x").otherwise(F.col("bundle_id")).alias("bundle_id"), F.when(k % 11 == 0, "x").otherwise(F.col("input_hash")).alias("input_hash"), (k % 5 != 0).alias("reused"))
    return G.same_rerun(first, again, "o_orderkey")


@query("""
SELECT l_orderkey, count(DISTINCT l_suppkey) AS parents, count(*) AS children, CAST(sum(l_linenumber * 10) AS BIGINT) AS tokens, bool_or(l_linenumber % 4 = 0) AS cross_page, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS reasons FROM lineitem GROUP BY l_orderkey
""")
def chunk_run_summary(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(1).alias("page_start"), F.when(n % 4 == 0, 2).otherwise(1).alias("page_end"), F.col("l_suppkey").alias("parent_id"), (n * 10).alias("token_count"), F.array("l_returnflag").alias("reasons"))
    return G.chunk_summary(rows, "l_orderkey")


@query("""
WITH c AS (SELECT c_custkey FROM customer), v AS (SELECT DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AS c_custkey FROM orders)
SELECT c_custkey, 'child_without_vector' AS error FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM v) UNION ALL SELECT c_custkey, 'vector_without_child' FROM v WHERE c_custkey NOT IN (SELECT c_custkey FROM c)
""")
def vector_alignment(spark, sf_dir):
    """Customers as children, orders as their vectors; every tenth order names another child."""
    c = F.col("o_custkey")
    vectors = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, -c).otherwise(c).alias("c_custkey")).distinct()
    return G.aligned(table(spark, sf_dir, "customer").select("c_custkey"), vectors, "c_custkey")[1]


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def ordered_unique(spark, sf_dir):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(G.ordered_unique(listed), ",").alias("kinds"))


@query("""
SELECT k AS bundle_id, r = '' AS ready, r AS blocking_reasons FROM (SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 6 = 0 THEN 'EMBEDDING_BUNDLE_INVALID' END, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 3 THEN 'EMBEDDING_ENGINE_SEMANTIC_MISMATCH' END,
  CASE WHEN o_orderkey % 4 = 3 THEN 'EMBEDDING_PROFILE_COMPATIBILITY_NOT_PROVEN' END, CASE WHEN o_orderkey % 4 IN (1, 3) THEN 'EMBEDDING_PROFILE_DOCUMENTS_DISABLED' END, CASE WHEN o_orderkey % 4 IN (2, 3) OR o_orderkey % 5 = 0 THEN 'INDEXING_TARGET_INCOMPATIBLE' END) AS r FROM orders)
""")
def indexing_readiness(spark, sf_dir):
    k, i = F.col("o_orderkey"), F.col("id")
    bundles = table(spark, sf_dir, "orders").select(k.alias("bundle_id"), (k % 4).alias("profile_id"), F.when(k % 6 == 0, "writing").otherwise("sealed").alias("status"), F.when(k % 7 == 0, "x").otherwise("f").alias("configuration_fingerprint"), F.when(k % 5 == 0, "l1").otherwise("l2").alias("metric"))
    profiles = spark.range(3).select(i.alias("profile_id"), F.lit(True).alias("proven"), (i != 1).alias("document_enabled"), F.lit(False).alias("waived"), F.lit("f").alias("expected_fingerprint"), F.lit("t").alias("vector_table"), i.alias("target_id"))
    targets = spark.range(3).select(i.alias("target_id"), (i != 2).alias("target_active"), F.lit("t").alias("target_table"), F.array(F.lit("l2")).alias("metrics"))
    return G.indexing_readiness(bundles, profiles, targets)


@query("""
WITH c AS (SELECT label AS b, vec_id % 3 AS t, count(*) AS n FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY 1, 2),
r AS (SELECT c_custkey AS run_id, c_custkey % 14 AS b, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 3 END AS t, c_custkey % 5 = 0 AS failed, c_custkey % 8 = 0 AS off FROM customer)
SELECT run_id, coalesce(n, 0) AS active_vector_rows, x = '' AS ready, x AS blocking_reasons FROM (SELECT r.*, n, concat_ws(',', CASE WHEN off THEN 'INDEXING_BUNDLE_NOT_ACTIVATED' END, CASE WHEN failed THEN 'INDEXING_RUN_NOT_COMPLETED' END,
  CASE WHEN r.t IS NULL THEN 'INDEXING_TARGET_INCOMPATIBLE' END, CASE WHEN r.t IS NOT NULL AND n IS NULL THEN 'NO_ACTIVE_VECTOR_ROWS' END) AS x FROM r LEFT JOIN c ON c.b = r.b AND c.t = r.t)
""")
def serving_readiness(spark, sf_dir):
    k, v = F.col("c_custkey"), F.col("vec_id")
    runs = table(spark, sf_dir, "customer").select(k.alias("run_id"), F.when(k % 5 == 0, "failed").otherwise("completed").alias("status"), F.when(k % 8 == 0, "superseded").otherwise("active").alias("activation_status"), (k % 14).alias("bundle_id"), F.when(k % 9 != 0, k % 3).alias("target_id"), F.lit("1").alias("corpus_version"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("bundle_id"), (v % 3).alias("target_id"), F.lit("1").alias("corpus_version"), (v % 4 != 0).alias("is_active"))
    return G.serving_readiness(runs, vectors)


@query("""
SELECT 'ownership' AS family, 'nation_missing' AS issue, CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_nationkey % 25 = 24
UNION ALL SELECT 'orphans', 'customer_missing', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 13 = 0 UNION ALL SELECT 'orphans', 'part_missing', CAST(l_partkey AS VARCHAR) FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey % 97 = 0)
UNION ALL SELECT 'releases', 'version_missing', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 89 = 0
UNION ALL SELECT 'runs', 'completed_without_bundle', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'materializations', 'count_differs', CAST(l_orderkey AS VARCHAR) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber))
UNION ALL SELECT 'vectors', 'dimension', CAST(vec_id AS VARCHAR) FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT 'project_mismatches', 'nation_differs', CAST(c_custkey AS VARCHAR) FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey <> s_nationkey
""")
def platform_health(spark, sf_dir):
    """Seven families of checks, one row a failing subject."""
    t = lambda name: table(spark, sf_dir, name)
    orders, items, customers = t("orders"), t("lineitem"), t("customer")
    # defects are changed keys and empty columns of whole tables
    changed = lambda c, n: F.when(F.col(c) % n == 0, -1 - F.col(c)).otherwise(F.col(c))
    placed = orders.select("o_orderkey", changed("o_custkey", 13).alias("c_custkey"), F.when(F.col("o_orderkey") % 89 != 0, "v").alias("version"))
    parts = items.select("l_partkey", changed("l_partkey", 97).alias("p_partkey")).distinct()
    owned = customers.select("c_custkey", F.when(F.col("c_nationkey") % 25 != 24, F.col("c_nationkey")).alias("owner"))
    counts = items.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last")).where("n <> last")
    other = customers.join(t("supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_nationkey"), "c_custkey").where("c_nationkey <> s_nationkey")
    return G.health(
        ownership=[("nation_missing", owned.where("owner is null"), "c_custkey")],
        orphans=[("customer_missing", placed.join(customers.select("c_custkey"), "c_custkey", "left_anti"), "o_orderkey"), ("part_missing", parts.join(t("part").select("p_partkey"), "p_partkey", "left_anti"), "l_partkey")],
        releases=[("version_missing", placed.where("version is null"), "o_orderkey")],
        runs=[("completed_without_bundle", orders.where("o_orderstatus = 'F'").join(items.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti"), "o_orderkey")],
        materializations=[("count_differs", counts, "l_orderkey")], vectors=[("dimension", t("embeddings").where("size(embedding) <> 64"), "vec_id")], project_mismatches=[("nation_differs", other, "c_custkey")],
    )
