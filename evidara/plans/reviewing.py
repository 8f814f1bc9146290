"""Review, layout and bundle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import checks as K
from evidara.operators import review as R
from evidara.plans.registry import query, table


@query("""
WITH i AS (SELECT o_orderkey, CAST(o_orderkey % 300 AS DOUBLE) AS w, CAST(o_custkey % 400 AS DOUBLE) AS h, CAST(o_orderkey % 792 AS DOUBLE) AS top, o_custkey % 60 AS words FROM orders),
r AS (SELECT *, round(w * h / (612.0::DOUBLE * 792.0), 6) AS ratio FROM i)
SELECT o_orderkey, ratio, CASE WHEN ratio < 0.05 AND top < 99 THEN 'logo' WHEN ratio >= 0.15 OR words < 20 THEN 'instruction' ELSE 'decoration' END AS kind FROM r
""")
def coverage_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = lambda c, n: (F.col(c) % n).cast("double")
    images = o.select("o_orderkey", d("o_orderkey", 300).alias("width"), d("o_custkey", 400).alias("height"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), d("o_orderkey", 792).alias("top"), (F.col("o_custkey") % 60).alias("words"))
    return R.coverage_candidates(images).select("o_orderkey", "ratio", "kind")


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
""")
def review_reasons(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = lambda cond, name: F.array(F.when(cond, F.lit(name)))
    short = one(F.col("n_chars") < 300, "short")
    found = R.reasons(short, one(F.col("lang") != "en", "language"), short, one(F.col("toxic") == 1, "toxic"))
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left").select("doc_id", F.array_join(found, ",").alias("reasons"))


@query("""
SELECT n_chars, CASE WHEN n = 1 THEN o END AS owner, CASE WHEN n = 0 THEN 'no_owner' WHEN n > 1 THEN 'several_owners' ELSE '' END AS reason
FROM (SELECT n_chars, count(DISTINCT lang) AS n, min(lang) AS o FROM documents GROUP BY n_chars)
""")
def sole_owner(spark, sf_dir):
    return R.sole_owner(table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("""
WITH w AS (SELECT conv_id, turn, max(CASE WHEN role = 'system' OR turn = 1 THEN turn END) OVER p AS s, max(CASE WHEN NOT (role = 'system' OR turn = 1) AND len(text) > 500 THEN turn END) OVER p AS e FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, s IS NOT NULL AND (e IS NULL OR e < s) AS in_contents FROM w
""")
def toc_state_machine(spark, sf_dir):
    label = (F.col("role") == "system") | (F.col("turn") == 1)
    return R.contents_runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", label=label, entry=F.length("text") <= 500).select("conv_id", "turn", "in_contents")


@query("""
WITH v AS (SELECT label AS bundle_id, vec_id AS node_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - CASE WHEN label = 3 THEN 0 ELSE 1 END AS off FROM embeddings),
c AS (SELECT bundle_id, min(off) = 0 AND max(off) = count(*) - 1 AND count(DISTINCT off) = count(*) AS dense_offsets, bool_and(len(embedding) = 64) AS dimension, bool_and(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS finite,
  bool_and(len(list_filter(embedding, lambda x: x <> 0)) > 0) AS non_zero, count(DISTINCT node_id) = count(*) AS unique_nodes FROM v GROUP BY bundle_id)
SELECT bundle_id, "check", passed FROM (UNPIVOT c ON dense_offsets, dimension, finite, non_zero, unique_nodes INTO NAME "check" VALUE passed)
""")
def embedding_bundle_validation(spark, sf_dir):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - F.when(F.col("label") == 3, 0).otherwise(1)
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("bundle_id"), F.col("vec_id").alias("node_id"), "embedding", at.alias("offset"))
    return R.bundle_checks(rows, dimension=64)


@query("""
SELECT o_custkey AS snapshot_id, CASE WHEN count(o_orderkey) = 0 THEN 'empty' WHEN count(DISTINCT o_orderkey) < count(o_orderkey) THEN 'duplicate' WHEN bool_or(o_orderkey % 50 = 0) THEN 'foreign_project'
  WHEN bool_or(o_orderkey % 40 = 1) THEN 'blocked' WHEN bool_or(o_orderkey % 20 = 2 AND o_custkey % 2 = 0) THEN 'needs_decision' ELSE '' END AS reason FROM orders GROUP BY 1
""")
def snapshot_eligibility(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = F.when(k % 40 == 1, "blocked").when(k % 20 == 2, "needs_review").otherwise("clean")
    rows = table(spark, sf_dir, "orders").select(
        c.alias("snapshot_id"), k.alias("revision_id"), F.when(k % 50 == 0, 1).otherwise(0).alias("project_id"), F.lit(0).alias("owner_id"), state.alias("review_state"), F.when(c % 2 != 0, "approved").alias("decision")
    )
    return R.snapshot_gate(rows)


@query("SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS r FROM (SELECT l_orderkey, l_linenumber + CASE WHEN l_partkey % 7 = 0 THEN 10 ELSE 0 END AS n FROM lineitem)) WHERE r <> n")
def page_contiguity(spark, sf_dir):
    """Line items as pages; every seventh part's page has a wrong number."""
    number = F.col("l_linenumber") + F.when(F.col("l_partkey") % 7 == 0, 10).otherwise(0)
    return K.contiguous(table(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("n")), ["l_orderkey"], "n")


@query("SELECT user_id, round(avg(value / 100), 6) AS confidence, count(*) FILTER (value / 100 < 0.5) AS low, count(*) AS words FROM events WHERE value >= 0 GROUP BY user_id")
def ocr_confidence(spark, sf_dir):
    c = F.col("value") / 100
    return table(spark, sf_dir, "events").where("value >= 0").groupBy("user_id").agg(F.round(F.avg(c), 6).alias("confidence"), F.count_if(c < 0.5).alias("low"), F.count("*").alias("words"))


@query("""
SELECT l_orderkey, spec, array_to_string(list_sort(list_distinct(flatten([range(a, a + b + 1), [c]]))), ',') AS pages
FROM (SELECT l_orderkey, l_linenumber, a || '-' || a + b || ' , ' || c AS spec, a, b, c FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_suppkey % 4 AS b, l_partkey % 9 + 1 AS c FROM lineitem))
""")
def page_spec(spark, sf_dir):
    a, b, c = F.col("l_linenumber"), F.col("l_suppkey") % 4, F.col("l_partkey") % 9 + 1
    text = lambda x: x.cast("string")
    specs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(text(a), F.lit("-"), text(a + b), F.lit(" , "), text(c)).alias("spec"))
    return specs.select("l_orderkey", "spec", F.array_join(T.page_spec(F.col("spec")).cast("array<string>"), ",").alias("pages"))


@query("""
SELECT l_orderkey, label, CAST(CASE WHEN word THEN 1 ELSE least(6, parts) END AS INTEGER) AS level
FROM (SELECT l_orderkey, l_linenumber % 3 = 0 AS word, l_quantity % 8 + 1 AS parts, CASE WHEN l_linenumber % 3 = 0 THEN 'Artículo ' ELSE '' END || array_to_string(list_transform(range(1, CAST(l_quantity AS BIGINT) % 8 + 2), lambda i: CAST(i AS VARCHAR)), '.') AS label FROM lineitem)
""")
def article_levels(spark, sf_dir):
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_quantity").cast("int") % 8 + 1), lambda i: i.cast("string")), ".")
    label = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "Artículo ").otherwise(""), numbers)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", label.alias("label")).select("l_orderkey", "label", R.article_level(F.col("label")).alias("level"))


@query("SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || 'chars: ' || n_chars || chr(10) || '---' AS front FROM documents")
def front_matter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.front_matter([("id", F.col("doc_id")), ("lang", F.col("lang")), ("chars", F.col("n_chars"))]).alias("front"))


@query("SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',')) AS checksum FROM embeddings")
def vector_checksum(spark, sf_dir):
    from evidara.functions import vectors as V

    return table(spark, sf_dir, "embeddings").select("vec_id", V.checksum(F.col("embedding")).alias("checksum"))


@query("SELECT l_returnflag, count(*) AS vectors, count(DISTINCT l_orderkey) AS bundles, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS states FROM lineitem GROUP BY l_returnflag")
def run_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("vectors"), F.countDistinct("l_orderkey").alias("bundles"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("states"))


@query("SELECT source, coalesce(max(n_chars), 0) + 1 AS next_version, max_by(doc_id, [n_chars, doc_id]) AS latest_doc FROM documents GROUP BY source")
def next_version(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.coalesce(F.max("n_chars"), F.lit(0)) + 1).alias("next_version"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("latest_doc"))
