"""Stored artifacts are read once a side, whatever fields are taken and filtered by."""

import pytest
from pyspark.sql import functions as F

from evidara.operators import versions


@pytest.mark.parametrize("kind", ("metadata", "pages"))
def test_payloads_are_parsed_once(spark, kind):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    payloads = spark.range(10).select(F.col("id").alias("artifact_id"), F.reverse(F.col("id").cast("string")).alias("body"))
    for side in versions.adapted(payloads, kind, root="/raw"):
        tree = side._jdf.queryExecution().optimizedPlan().toString()
        assert tree.count("reverse(") <= 2 + (kind == "pages" and side.columns[-1] == "reason") * 2  # one test for null, one parse; refused payloads of items have two sources
