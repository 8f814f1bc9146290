"""Backfills add all absent pairs, and shuffle none of them."""

import random

from evidara.operators import selection as S


def test_backfill_against_all_pairs(spark):
    rng = random.Random(3)
    docs = [(i if i else None, rng.choice(("a", "b", None)), i * 2) for i in range(40)] + [(5, "a", 1)]
    profiles = [(i if i else None, rng.choice(("a", "a", "b", None)), rng.random() < 0.8, f"p{i}") for i in range(200)] + [(7, "b", True, "again"), (7, "a", True, "more")]
    existing = [(rng.randint(0, 40), rng.randint(0, 199)) for _ in range(900)] * 2 + [(None, 3), (3, None)]
    want = sorted((str((d[1], d[0], d[2], p[0], p[3])) for d in docs for p in profiles if p[2] and d[1] == p[1] and d[1] is not None and ((d[0], p[0]) not in existing or None in (d[0], p[0]))))
    found = S.backfill(spark.createDataFrame(docs, "document_id int, g string, x int"), spark.createDataFrame(profiles, "profile_id int, g string, active boolean, name string"), spark.createDataFrame(existing, "document_id int, profile_id int"), ["g"])
    assert found.columns == ["g", "document_id", "x", "profile_id", "name"]
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
