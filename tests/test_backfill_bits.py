"""Backfills move bits of many profiles a row, and look places up without moving pairs."""

import random

import pytest

from evidara.operators import selection as S


@pytest.mark.parametrize("few", (1 << 19, 0))
def test_pairs_stay_where_they_are(spark, monkeypatch, few):
    """Also where Spark would broadcast nothing by itself; beyond FEW profiles the rows are the same."""
    monkeypatch.setattr(S, "FEW", few, raising=False)
    rng = random.Random(5)
    docs = [(i, rng.choice(("a", "b"))) for i in range(12)]
    profiles = [(3 * i, "a" if i % 9 else "b", i % 11 != 0) for i in range(1400)]
    existing = [(rng.randrange(12), 3 * rng.randrange(1400)) for _ in range(4000)]
    gone = set(existing)
    want = sorted((d, p) for d, g in docs for p, h, active in profiles if active and g == h and (d, p) not in gone)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.backfill(spark.createDataFrame(docs, "document_id int, g string"), spark.createDataFrame(profiles, "profile_id int, g string, active boolean"), spark.createDataFrame(existing, "document_id int, profile_id int"), ["g"])
        assert sorted((r.document_id, r.profile_id) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert few == 0 or "hashpartitioning(profile_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
