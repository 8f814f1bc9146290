"""Requests are dealt by number, so compressed sizes do not join their partitions."""

from pyspark.sql import functions as F

from evidara.operators import documents


def test_preflight_is_dealt_by_number(spark):
    requests = spark.range(60).select((F.col("id") % 20).alias("request_id"), F.lit(1).alias("project_id"), (F.col("id") % 2).alias("variant_id"), F.col("id").alias("ordinal"), (F.col("id") % 7).alias("revision_id"))
    variants, revisions = spark.createDataFrame([(0, 1), (1, 2)], "variant_id long, variant_project int"), spark.range(7).select(F.col("id").alias("revision_id"), F.lit(1).alias("revision_project"))
    found = documents.preflight(requests, variants, revisions)
    got = {r.request_id: (r.reason, r.revision_ids) for r in found.collect()}
    assert got == {i: ("", list(dict.fromkeys(x % 7 for x in (i, i + 20, i + 40)))) if i % 2 == 0 else ("variant_of_other_project", None) for i in range(20)}
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") in (2, 4)  # a finished adaptive plan shows its stages twice
