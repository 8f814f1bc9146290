"""Checks, review lists and platform queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import checks as K
from evidara.operators import platform as P
from evidara.operators import structure as S
from evidara.plans.registry import query, table
from evidara.sources import files


@query("""
SELECT 'lineitem_part' AS "check", CAST(l_partkey AS VARCHAR) AS subject FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0))
UNION ALL SELECT 'orders_customer', CAST(o_custkey AS VARCHAR) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0))
UNION ALL SELECT 'supplier_nation', CAST(s_nationkey AS VARCHAR) FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0))
""")
def orphan_anti_joins(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return K.all_issues(
        K.orphans(t("lineitem"), t("part").where("p_partkey % 11 <> 0").withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"], "lineitem_part"),
        K.orphans(t("orders"), t("customer").where("c_custkey % 13 <> 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], "orders_customer"),
        K.orphans(t("supplier"), t("nation").where("n_regionkey > 0").withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"], "supplier_nation"),
    )


@query("SELECT c_custkey, s_suppkey, CASE WHEN c_nationkey > s_nationkey THEN 'after' ELSE 'before' END AS side FROM customer JOIN supplier ON c_custkey // 10 = s_suppkey AND c_nationkey <> s_nationkey")
def project_mismatch_theta(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    joined = c.join(s, (F.floor(F.col("c_custkey") / 10) == F.col("s_suppkey")) & (F.col("c_nationkey") != F.col("s_nationkey")))
    return joined.select("c_custkey", "s_suppkey", F.when(F.col("c_nationkey") > F.col("s_nationkey"), "after").otherwise("before").alias("side"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing_left' ELSE 'missing_right' END AS side
FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id FROM documents) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL
""")
def inventory_bijection(spark, sf_dir):
    """Documents, every ninth under another id, against labels."""
    d = F.col("doc_id")
    return K.bijection(table(spark, sf_dir, "documents").select(F.when(d % 9 == 0, -1 - d).otherwise(d).alias("doc_id")), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderkey AS key, CASE WHEN l.k IS NULL THEN 'missing_right' END AS side FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber > 1) l ON l.k = o_orderkey WHERE l.k IS NULL")
def set_equality_check(spark, sf_dir):
    return K.bijection(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("key")), "key")


@query("""
SELECT r_regionkey AS binding_id, n_name AS processing, c AS chunking, r_regionkey || '|' || n_name || '|' || c AS cell_id FROM region CROSS JOIN nation CROSS JOIN (VALUES ('small'), ('large')) AS t(c)
""")
def variant_matrix(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("processing"))
    return P.variant_matrix(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("binding_id")), n, spark.createDataFrame([("small",), ("large",)], "chunking string"))


@query("""
SELECT l_linestatus AS mode, l_returnflag AS flag, count(DISTINCT l_orderkey) AS bundles, count(DISTINCT l_suppkey) AS materializations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2
""")
def engine_selection(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_orderkey").alias("bundle_id"), F.col("l_linestatus").alias("mode"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("materialization_id"))
    done = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "sealed").otherwise("writing").alias("status"))
    return P.engines(li, done, keys=["k"], by=["mode", "flag"])


@query("SELECT o_custkey, min(o_orderkey) AS version, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) <> 1")
def version_bindings_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("version"), F.count("*").alias("n")).where("n <> 1")


_DIGESTED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
_STATE_SQL = "WITH m AS (%s), s AS (SELECT " + ", ".join(f"CAST(sum(CAST('0x' || substr(m, {4 * i + 1}, 4) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(8)) + ", count(*) AS n FROM m) "
_STATE_SQL += "SELECT sha256(concat_ws(':', " + ", ".join(f"s{i}" for i in range(8)) + ", CAST(n AS VARCHAR))) AS digest, n AS n_rows FROM s"
_ROW_MD5 = "md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), %s)) AS m FROM lineitem"


@query("""
WITH m AS (SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag)) AS m FROM lineitem),
s AS (SELECT left(m, 3) AS p, md5(string_agg(m, '' ORDER BY m)) AS d, count(*) AS n FROM m GROUP BY 1)
SELECT md5(string_agg(d, '' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n_rows FROM s
""")
def table_digest(spark, sf_dir):
    return K.ordered_digest(table(spark, sf_dir, "lineitem"), _DIGESTED)


@query(_STATE_SQL % ("SELECT " + _ROW_MD5 % "CASE WHEN l_linenumber = 2 THEN 'Z' ELSE l_returnflag END" + " UNION ALL SELECT " + _ROW_MD5 % "l_returnflag" + " WHERE l_suppkey % 5 = 0"))
def digest_after_changes(spark, sf_dir):
    """The state of the old table, without the rows that changed, with their new versions and some rows once more."""
    rows = table(spark, sf_dir, "lineitem")
    state = lambda df: K.digest_state(df, _DIGESTED)
    old = rows.where("l_linenumber = 2")
    new = old.withColumn("l_returnflag", F.lit("Z")).select(*_DIGESTED).unionAll(rows.where("l_suppkey % 5 = 0").select(*_DIGESTED))
    return K.digest_of(K.changed_state(state(rows), added=state(new), gone=state(old)))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS manifest_hash, count(*) AS n_members FROM conversations GROUP BY conv_id")
def content_fingerprint(spark, sf_dir):
    return K.manifest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


_STATES = ("draft", "building", "built", "validated", "published", "retired", "failed")
_STATE = "(['" + "', '".join(_STATES) + "'])[%s %% 7 + 1]"


@query(f"""
WITH m AS (SELECT o_orderkey AS release_id, {_STATE % 'o_orderkey'} AS before, {_STATE % 'o_custkey'} AS after FROM orders)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in P.TRANSITIONS)}) AS t(a, b) WHERE a = before AND b = after)
""")
def release_transitions(spark, sf_dir):
    state = lambda c: F.element_at(F.array(*[F.lit(x) for x in _STATES]), (F.col(c) % 7 + 1).cast("int"))
    return P.illegal_moves(spark, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("release_id"), state("o_orderkey").alias("before"), state("o_custkey").alias("after"))).select("release_id", "before", "after")


@query("""
SELECT d.doc_id, CASE WHEN k.h IS NOT NULL THEN 'reused' ELSE 'built' END AS outcome FROM (SELECT doc_id, sha256(text) AS h FROM documents) d
LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) k ON k.h = d.h
""")
def artifact_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return P.reuse(docs, docs.where("doc_id % 2 = 0").select(F.col("h").alias("h")), ["h"]).select("doc_id", "outcome")


@query("SELECT conv_id, count(*) AS n, max(turn) = count(*) - 1 AND min(turn) = 0 AND count(DISTINCT turn) = count(*) AS dense FROM conversations GROUP BY conv_id")
def ordinals_dense_check(spark, sf_dir):
    return K.dense(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("""
SELECT page_num, block_num, 1 AS par_num, line_num, string_agg(text, ' ' ORDER BY "left", text) AS text, round(avg(conf / 100), 6) AS confidence FROM (
  SELECT l_orderkey AS page_num, l_suppkey % 2 AS block_num, l_linenumber % 3 AS line_num, l_partkey AS "left", CAST(l_quantity - 5 AS DOUBLE) AS conf, 'w' || l_suppkey AS text, l_suppkey % 5 = 0 AS blank FROM lineitem) WHERE conf >= 0 AND NOT blank GROUP BY ALL
""")
def ocr_line_regroup(spark, sf_dir):
    """Words from line items: some without confidence, some blank."""
    word = F.when(F.col("l_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("l_suppkey").cast("string")))
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_num"), (F.col("l_suppkey") % 2).alias("block_num"), F.lit(1).alias("par_num"), (F.col("l_linenumber") % 3).alias("line_num"), F.col("l_partkey").alias("left"), (F.col("l_quantity") - 5).cast("double").alias("conf"), word.alias("text")
    )
    return files.ocr_lines(words)


@query("""
SELECT doc_id, status, decision, coalesce(status = 'processed' OR (status = 'needs_review' AND decision = 'approved'), FALSE) AS eligible,
  CASE WHEN status = 'processed' OR (status = 'needs_review' AND coalesce(decision = 'approved', FALSE)) THEN '' WHEN status = 'needs_review' THEN CASE WHEN decision IS NULL THEN 'review_pending' ELSE 'review_rejected' END ELSE 'not_processed' END AS reason
FROM (SELECT d.doc_id, CASE WHEN n_chars > 1500 THEN 'processed' WHEN n_chars > 200 THEN 'needs_review' ELSE 'failed' END AS status, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' END AS decision
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)
""")
def eligibility(spark, sf_dir):
    return P.eligibility(_reviewed(spark, sf_dir)).select("doc_id", "status", "decision", "eligible", "reason")


def _reviewed(spark, sf_dir):
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = F.col("n_chars")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.when(n > 1500, "processed").when(n > 200, "needs_review").otherwise("failed").alias("status"))
    return docs.join(quality, "doc_id", "left").withColumn("decision", F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected"))


@query("""
WITH r AS (SELECT d.*, CASE WHEN n_chars > 1500 THEN 'processed' WHEN n_chars > 200 THEN 'needs_review' ELSE 'failed' END AS status, quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)
SELECT source, count(*) AS total, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (status = 'needs_review' AND quality IS NULL) AS pending FROM r GROUP BY source
""")
def status_dashboard(spark, sf_dir):
    s, d = F.col("status"), F.col("decision")
    return _reviewed(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(s == "processed").alias("processed"), F.count_if(s == "needs_review").alias("needs_review"), F.count_if(s == "failed").alias("failed"),
        F.count_if(d == "approved").alias("approved"), F.count_if(d == "rejected").alias("rejected"), F.count_if((s == "needs_review") & d.isNull()).alias("pending"),
    )


@query("SELECT doc_id, lang, source FROM documents WHERE (contains(lower(lang), 'src1') OR contains(lower(source), 'src1') OR len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'with the'))) > 0) AND lang IN ('en', 'fr')")
def review_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    needle = lambda c, x: F.contains(F.lower(c), F.lit(x))
    hit = needle("lang", "src1") | needle("source", "src1") | F.exists(F.split(F.lower("text"), "\n"), lambda x: F.contains(x, F.lit("with the")))
    return docs.where(hit & F.col("lang").isin("en", "fr")).select("doc_id", "lang", "source")


@query("""
SELECT n.doc_id, CASE WHEN p.h IS NOT DISTINCT FROM n.h AND p.status IN ('processed', 'needs_review') THEN 'skip' ELSE 'process' END AS action
FROM (SELECT doc_id, sha256(text) AS h FROM documents) n LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS h, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'processed' END AS status FROM documents WHERE doc_id % 3 <> 0) p USING (doc_id)
""")
def incremental_skip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    before = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("h")).alias("old"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("processed").alias("status"))
    same = F.col("old").eqNullSafe(F.col("h")) & F.col("status").isin("processed", "needs_review")
    return docs.join(before, "doc_id", "left").select("doc_id", F.when(same, "skip").otherwise("process").alias("action"))


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def pagination(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    page = orders.orderBy("o_orderkey").offset(50).limit(25)
    return page.crossJoin(orders.agg(F.count("*").alias("total")))


@query("SELECT conv_id, round(count(DISTINCT CASE WHEN role = 'user' THEN turn END) / count(DISTINCT turn), 6) AS coverage FROM conversations GROUP BY conv_id")
def page_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.round(F.countDistinct(F.when(F.col("role") == "user", F.col("turn"))) / F.countDistinct("turn"), 6).alias("coverage"))


@query("SELECT source, round(avg(CASE WHEN quality IS NOT DISTINCT FROM CAST(n_chars > 500 AS INTEGER) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id GROUP BY source")
def exact_match_rate(spark, sf_dir):
    same = F.col("quality").eqNullSafe((F.col("n_chars") > 500).cast("int"))
    return _reviewed(spark, sf_dir).groupBy("source").agg(F.round(F.avg(same.cast("double")), 6).alias("rate"))


@query("SELECT count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings, 'failed' AS status FROM (SELECT n_chars > 100 AS passed, CASE WHEN lang = 'en' THEN 'error' ELSE 'warning' END AS severity FROM documents)")
def validation_rollup(spark, sf_dir):
    return K.roll_up(table(spark, sf_dir, "documents").select(F.lit("length").alias("check"), (F.col("n_chars") > 100).alias("passed"), F.when(F.col("lang") == "en", "error").otherwise("warning").alias("severity")))


@query("""
SELECT vec_id, array_to_string(list_sort(list_filter([CASE WHEN d.doc_id IS NULL THEN 'orphan' END, CASE WHEN d.n_chars <= 200 THEN 'unapproved' END, CASE WHEN e.label > 7 THEN 'mixed_lane' END, CASE WHEN len(e.embedding) <> 64 THEN 'dimension' END], lambda x: x IS NOT NULL)), ',') AS problems
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 3 WHERE d.doc_id IS NULL OR d.n_chars <= 200 OR e.label > 7 OR len(e.embedding) <> 64
""")
def index_validation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("vec_id") * 3)
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(True).alias("have"))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    problems = F.array_sort(F.array_compact(F.array(flag(F.col("have").isNull(), "orphan"), flag(F.col("n_chars") <= 200, "unapproved"), flag(F.col("label") > 7, "mixed_lane"), flag(F.size("embedding") != 64, "dimension"))))
    return e.join(d, "doc_id", "left").withColumn("p", problems).where(F.size("p") > 0).select("vec_id", F.array_join("p", ",").alias("problems"))


@query("SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, o_custkey, c_custkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_totalprice / 100 - c_acctbal), c_custkey) AS k FROM orders JOIN customer ON o_custkey % 40 = c_custkey % 40 AND abs(o_totalprice / 100 - c_acctbal) <= 500) WHERE k = 1")
def nearest_label_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("k"), (F.col("o_totalprice") / 100).alias("price"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("k"), "c_acctbal")
    return S.nearest_within(o, c, on=["k"], left_value="price", right_value="c_acctbal", within=500, left_key="o_orderkey", right_key="c_custkey")


@query("SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 20 MINUTE GROUP BY a.event_id")
def near_start_range_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    pairs = S.starts_within(e, on=["user_id"], at="at", key="event_id", within=20 * 60 * 1_000_000)
    return e.select("event_id").join(pairs, "event_id", "left").groupBy("event_id").agg(F.count("other").alias("n"))
