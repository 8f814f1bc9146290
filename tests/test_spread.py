"""Work that stays bounded a task or a row, seen in plans."""

from pyspark.sql import functions as F

from evidara.operators import lineage, platforms


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_rows(spark):
    assert lineage.parts(spark.range(1001), rows=10) == 101 and lineage.parts(spark.range(1), rows=10) == spark.sparkContext.defaultParallelism


def test_append_inactive_is_dealt_by_number_and_never_broadcast(spark):
    stored = spark.range(20).select(F.col("id").alias("k"), (F.col("id") % 2 == 0).alias("is_active"), F.lit("old").alias("v"))
    new = spark.range(10, 25).select(F.col("id").alias("k"), F.lit("new").alias("v"))
    found = platforms.append_inactive(stored, new, ["k"])
    assert {(r.k, r.is_active, r.v) for r in found.collect()} == {(i, i < 20 and i % 2 == 0, "old" if i < 10 else "new") for i in range(25)}
    assert "REPARTITION_BY_NUM" in plan(found) and "Broadcast" not in plan(found)
