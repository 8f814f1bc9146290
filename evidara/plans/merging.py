"""Merges and lanes: embeddings stand for vector rows, customers and orders for tables that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import lanes as L
from evidara.operators import lineage
from evidara.plans.registry import query, table

_AT = "2026-01-01 00:00:00"
_ROWS = """SELECT vec_id AS node_id, 'p' || label % 2 AS project_id, 'f' AS profile_id, vec_id % 40 AS document_id, 'b' || vec_id % 3 AS bundle_id, vec_id % 3 = 0 AS is_active,
  CASE WHEN vec_id % 3 = 2 THEN TIMESTAMP '2025-06-01 00:00:00' END AS superseded_at FROM embeddings"""


def lane_rows(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("node_id"), F.concat(F.lit("p"), (F.col("label") % 2).cast("string")).alias("project_id"), F.lit("f").alias("profile_id"), (v % 40).alias("document_id"), F.concat(F.lit("b"), (v % 3).cast("string")).alias("bundle_id"),
        (v % 3 == 0).alias("is_active"), F.when(v % 3 == 2, F.lit("2025-06-01 00:00:00").cast("timestamp")).alias("superseded_at"),
    )


def _shown(df):
    return df.select("node_id", "bundle_id", "is_active", F.date_format("superseded_at", "yyyy-MM-dd").alias("superseded"))


@query(f"""
WITH r AS ({_ROWS}), t AS (SELECT DISTINCT project_id, profile_id, document_id FROM r WHERE bundle_id = 'b1'),
j AS (SELECT r.*, t.document_id IS NOT NULL AS touched FROM r LEFT JOIN t USING (project_id, profile_id, document_id))
SELECT node_id, bundle_id, CASE WHEN bundle_id = 'b1' THEN TRUE WHEN touched THEN FALSE ELSE is_active END AS is_active,
  strftime(CASE WHEN bundle_id = 'b1' THEN NULL WHEN touched AND is_active THEN TIMESTAMP '{_AT}' ELSE superseded_at END, '%Y-%m-%d') AS superseded FROM j
""")
def activate_supersede(spark, sf_dir):
    return _shown(L.activate(lane_rows(spark, sf_dir), "b1", _AT))


@query(f"""
WITH r AS ({_ROWS}), h AS (SELECT DISTINCT project_id, profile_id, document_id FROM r WHERE bundle_id = 'b0' AND is_active), l AS (SELECT DISTINCT project_id AS p, profile_id AS q FROM r WHERE bundle_id = 'b2'),
j AS (SELECT r.*, h.document_id IS NOT NULL AND l.p IS NOT NULL AS may FROM r LEFT JOIN h ON h.project_id = r.project_id AND h.profile_id = r.profile_id AND h.document_id = r.document_id LEFT JOIN l ON l.p = r.project_id AND l.q = r.profile_id)
SELECT node_id, bundle_id, CASE WHEN may AND bundle_id = 'b0' THEN FALSE WHEN may AND bundle_id = 'b2' THEN TRUE ELSE is_active END AS is_active,
  strftime(CASE WHEN may AND bundle_id = 'b0' AND is_active THEN TIMESTAMP '{_AT}' WHEN may AND bundle_id = 'b2' THEN NULL ELSE superseded_at END, '%Y-%m-%d') AS superseded FROM j
""")
def rollback(spark, sf_dir):
    return _shown(L.rollback(lane_rows(spark, sf_dir), "b0", "b2", _AT))


@query("""
WITH c AS (SELECT label, max(vec_id) AS chosen FROM embeddings WHERE label < 5 GROUP BY label)
SELECT e.vec_id, e.label, CASE WHEN chosen IS NULL THEN e.vec_id % 7 = 0 ELSE e.vec_id = chosen END AS active FROM embeddings e LEFT JOIN c ON c.label = e.label
""")
def single_active_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7 == 0).alias("active"))
    chosen = table(spark, sf_dir, "embeddings").where("label < 5").groupBy("label").agg(F.max("vec_id").alias("vec_id"))
    return L.only_active(rows, ["label"], "vec_id", chosen)


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    new = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), "c_nationkey", F.lit(0.0).alias("c_acctbal"))
    return c, new


_OLD = "SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer"
_NEW = "SELECT c_custkey * 2 AS c_custkey, c_nationkey, CAST(0 AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey % 5 = 0"


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n")
def upsert_merge(spark, sf_dir):
    return L.upsert(*_customers(spark, sf_dir), ["c_custkey"])


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def insert_if_absent(spark, sf_dir):
    return L.insert_if_absent(*_customers(spark, sf_dir), ["c_custkey"])


@query(f"WITH o AS ({_OLD}), n AS (SELECT * FROM ({_NEW}) WHERE c_nationkey < 8) SELECT * FROM o WHERE c_nationkey NOT IN (SELECT c_nationkey FROM n) UNION ALL SELECT * FROM n")
def scoped_replace(spark, sf_dir):
    old, new = _customers(spark, sf_dir)
    return L.replace_scope(old, new.where("c_nationkey < 8"), ["c_nationkey"])


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'sealed' ELSE 'writing' END AS status, 1 AS version FROM orders),
n AS (SELECT o_orderkey, 'sealed' AS status, 2 AS version FROM orders WHERE o_orderkey % 6 = 0)
SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL AND o.status <> 'sealed' THEN n.status ELSE o.status END AS status, CASE WHEN n.o_orderkey IS NOT NULL AND o.status <> 'sealed' THEN 2 ELSE 1 END AS version
FROM o LEFT JOIN n USING (o_orderkey)
""")
def seal_once(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "sealed").otherwise("writing").alias("status"), F.lit(1).alias("version"))
    new = orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit("sealed").alias("status"), F.lit(2).alias("version"))
    return L.seal_once(old, new, "o_orderkey")[0]


@query(f"""
WITH r AS ({_ROWS}), t AS (SELECT DISTINCT document_id FROM r WHERE bundle_id = 'b1' AND project_id = 'p0'),
j AS (SELECT r.*, r.project_id = 'p0' AND t.document_id IS NOT NULL AS touched FROM r LEFT JOIN t USING (document_id))
SELECT node_id, bundle_id, CASE WHEN project_id = 'p0' AND bundle_id = 'b1' THEN TRUE WHEN touched THEN FALSE ELSE is_active END AS is_active,
  strftime(CASE WHEN project_id = 'p0' AND bundle_id = 'b1' THEN NULL WHEN touched AND is_active THEN TIMESTAMP '{_AT}' ELSE superseded_at END, '%Y-%m-%d') AS superseded FROM j
""")
def lane_activation(spark, sf_dir):
    """A stored table of lanes, one of which activates a bundle."""
    path = lineage.new_path(spark, "lanes")
    L.write_lanes(lane_rows(spark, sf_dir), path)
    L.activate_in(spark, path, "p0", "f", "b1", _AT)
    return _shown(spark.read.parquet(path))


@query("""
WITH b AS (SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS sealed, o_custkey % 2 AS profile, o_orderkey % 5 = 0 AS late FROM orders), r AS (SELECT o_orderkey AS c, o_orderkey - o_custkey % 4 * 32 AS p FROM orders)
SELECT r.c AS current, r.p AS previous, CASE WHEN y.id IS NULL THEN 'unknown_bundle' WHEN NOT y.sealed THEN 'previous_not_sealed' WHEN x.profile <> y.profile THEN 'other_profile' WHEN x.late <> y.late THEN 'other_corpus_version' ELSE '' END AS reason
FROM r JOIN b x ON x.id = r.c LEFT JOIN b y ON y.id = r.p
""")
def rollback_conditions(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    bundles = orders.select(k.alias("bundle_id"), (k % 3 != 0).alias("is_sealed"), (c % 2).alias("profile_id"), F.when(k % 5 == 0, "late").otherwise("early").alias("corpus_version"))
    return L.rollback_reasons(orders.select(k.alias("current"), (k - c % 4 * 32).alias("previous")), bundles).select("current", "previous", "reason")
