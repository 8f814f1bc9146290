"""Targets of profiles: one row a profile meets one row a table and metric."""

from pyspark.sql import functions as F

from evidara.operators import gates as G


def test_profiles_meet_one_target_each(spark):
    profiles = spark.range(3000).select(F.col("id").alias("profile_id"), F.when(F.col("id") == 0, "none").otherwise("t").alias("vector_table"), F.lit("l2").alias("metric"))
    targets = spark.range(1, 3001).select(F.col("id").alias("target_id"), F.lit("t").alias("target_table"), F.when(F.col("id") < 7, F.array(F.lit("cosine"))).otherwise(F.array(F.lit("l2"), F.lit("l2"))).alias("metrics"))
    found = G.provision(profiles, targets)
    assert {(r.target_id, r.n) for r in found.groupBy("target_id").agg(F.count("*").alias("n")).collect()} == {(None, 1), (7, 2999)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(target_id" in plan.partition("Join")[2]  # below the join, too
