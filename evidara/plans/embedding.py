"""Vectors of all documents by an engine that is a parameter."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import engines
from evidara.plans.registry import query, table, texts

_BYTE = "CAST(CAST('0x' || substr(sha256(i || ':' || text), 1, 2) AS INTEGER) AS DOUBLE) / 255"


@query(f"""
SELECT doc_id, 'sha256' AS model, CAST(4 AS INTEGER) AS dimension, CASE WHEN coalesce(trim(text), '') = '' THEN 'no_text' ELSE '' END AS reason, CASE WHEN coalesce(trim(text), '') <> '' THEN round(list_sum(list_transform(range(4), lambda i: CAST({_BYTE} AS FLOAT))), 5) END AS total FROM documents
""")
def engine_vectors(spark, sf_dir):
    made = engines.embedded(texts(spark, sf_dir), engines.hashed(4), key="doc_id")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5)
    return made.select("doc_id", "model", "dimension", "reason", total.alias("total"))


@query("""
SELECT c_custkey AS profile_id, concat_ws(',', CASE WHEN c_nationkey % 3 = 0 THEN 'other_model' END, CASE WHEN c_nationkey % 4 = 1 THEN 'other_dimension' END) AS reasons FROM customer WHERE c_nationkey % 3 = 0 OR c_nationkey % 4 = 1
""")
def engine_profiles(spark, sf_dir):
    n, e = F.col("c_nationkey"), engines.hashed(4)
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.lit(e.provider).alias("provider"), F.when(n % 3 == 0, "other").otherwise(e.model).alias("model"), F.lit(e.revision).alias("model_revision"), F.when(n % 4 == 1, 8).otherwise(4).alias("dimension"))
    return engines.unfit(e, profiles)
