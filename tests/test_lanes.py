"""Lanes of stored tables: what a change touches, and what keeps its files."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import checks, lanes, retrieval

SCHEMA = "node_id int, project_id string, profile_id string, document_id int, bundle_id string, is_active boolean, superseded_at timestamp"


def stored(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    rows = [(100 * p + i, f"p{p}", f"f{i % 2}", i % 5, f"b{i % 3}", i % 3 == 0, None) for p in range(3) for i in range(30)]
    lanes.write_lanes(spark.createDataFrame(rows, SCHEMA), path)
    return path, rows


def parts(tmp_path):
    return {f.split("/vectors/")[1] for f in glob.glob(f"{tmp_path}/vectors/*/*/*.parquet")}


def values(df):
    return sorted(map(tuple, df.select(*[x.split()[0] for x in SCHEMA.split(", ")]).collect()))


def test_activation_touches_one_lane(spark, tmp_path):
    path, rows = stored(spark, tmp_path)
    before = parts(tmp_path)
    want = values(lanes.activate(spark.createDataFrame(rows, SCHEMA).where("project_id = 'p1' and profile_id = 'f0'"), "b1", "2026-01-01"))
    assert lanes.activate_in(spark, path, "p1", "f0", "b1", "2026-01-01") == sum(x[4] == "b1" for x in want)
    mine = "project_id=p1/profile_id=f0"
    assert {f for f in before if not f.startswith(mine)} == {f for f in parts(tmp_path) if not f.startswith(mine)} and not before & {f for f in parts(tmp_path) if f.startswith(mine)}
    assert values(lanes.one_lane(spark, path, "p1", "f0")) == want and spark.read.parquet(path).count() == len(rows)
    plan = lanes.one_lane(spark, path, "p1", "f0")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan


def test_rollback_keeps_its_conditions(spark, tmp_path):
    path, _ = stored(spark, tmp_path)
    bundles = lambda **kw: spark.createDataFrame([("b0", True, "f", kw.get("old", "c1")), ("b1", True, "f", "c1"), ("b2", kw.get("sealed", True), kw.get("profile", "f"), "c1")], "bundle_id string, is_sealed boolean, profile_id string, corpus_version string")
    lanes.activate_in(spark, path, "p0", "f1", "b1", "2026-01-01")
    before = values(spark.read.parquet(path))
    for current, previous, known, reason in (("b1", "b2", bundles(sealed=False), "previous_not_sealed"), ("b1", "b2", bundles(profile="g"), "other_profile"), ("b1", "b0", bundles(old="c0"), "other_corpus_version"), ("b1", "b9", bundles(), "unknown_bundle")):
        with pytest.raises(ValueError, match=reason):
            lanes.rollback_in(spark, path, "p0", "f1", current, previous, "2026-02-01", known)
    assert values(spark.read.parquet(path)) == before
    lanes.rollback_in(spark, path, "p0", "f1", "b1", "b0", "2026-02-01", bundles())
    lane = values(lanes.one_lane(spark, path, "p0", "f1"))
    assert all(r[5] == (r[4] == "b0") for r in lane if r[4] != "b2")


def test_upserts_and_scopes_touch_the_lanes_of_the_change(spark, tmp_path):
    path, rows = stored(spark, tmp_path)
    before = parts(tmp_path)
    new = spark.createDataFrame([(4, "p0", "f0", 9, "new", True, None), (7777, "p0", "f0", 9, "new", True, None), (7778, "p9", "f0", 9, "new", True, None)], SCHEMA)
    lanes.upsert_in(spark, path, new, ["project_id", "profile_id", "node_id"])
    want = sorted([r for r in rows if r[0] != 4] + [tuple(r) for r in new.collect()])
    assert values(spark.read.parquet(path)) == want
    assert {f for f in before if not f.startswith("project_id=p0/profile_id=f0")} <= parts(tmp_path)
    scope = ["project_id", "profile_id", "document_id"]
    lanes.replace_in(spark, path, spark.createDataFrame([(5000, "p2", "f1", 3, "z", True, None)], SCHEMA), scope)
    want = sorted([r for r in want if r[1:4] != ("p2", "f1", 3)] + [(5000, "p2", "f1", 3, "z", True, None)])
    assert values(spark.read.parquet(path)) == want


def test_a_wrong_count_changes_nothing(spark, tmp_path):
    path, rows = stored(spark, tmp_path)
    with pytest.raises(ValueError, match="nothing was changed"):
        lanes._swap(lanes.one_lane(spark, path, "p1", "f0").limit(3), path, 15)
    assert spark.read.parquet(path).count() == len(rows)


@pytest.mark.parametrize("metric", ("cosine", "l2", "inner_product"))
def test_block_top_k_is_all_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "DATA_BLOCK", 30)
    monkeypatch.setattr(retrieval, "TILE", 3)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(120, 6)), 1).astype(np.float32)
    v[5] = v[7] = v[9] = v[40]  # ties
    v[11] = 0
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "node_id long, embedding array<float>")
    queries = data.where("node_id % 6 = 5 or node_id = 500").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query"))
    df = retrieval.batch_topk(queries, data, 4, metric=metric)
    w = v.astype(np.float64)
    want = set()
    for q in range(5, 120, 6):
        dot = w @ w[q]
        norms = np.sqrt((w * w).sum(1)) * np.sqrt((w[q] * w[q]).sum())
        score = {"cosine": np.divide(dot, norms, out=np.zeros(120), where=norms > 0), "l2": 1 - np.sqrt(((w - w[q]) ** 2).sum(1)), "inner_product": 1 + dot}[metric]
        best = sorted((-round(s, 6), i) for i, s in enumerate(score.tolist()) if i != q)[:4]
        want |= {(q, i, rank, round(-s, 5)) for rank, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.node_id, r["rank"], round(r.score, 5)) for r in df.collect()} == want
    plan = df._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_digests_of_any_layout_and_after_changes(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 20), rng.choice("abc")) for _ in range(400)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "k int, v string")
    digest = lambda d: tuple(checks.table_digest(d, ["k", "v"]).first())
    assert digest(df) == digest(df.repartition(13, "v")) == digest(spark.createDataFrame(rows[::-1], df.schema)) and digest(df)[1] == 403
    assert len({digest(df), digest(spark.createDataFrame(rows[1:], df.schema)), digest(spark.createDataFrame([*rows, rows[0]], df.schema))}) == 3
    gone, added = spark.createDataFrame(rows[:50], df.schema), spark.createDataFrame([(99, "z"), (99, "z"), rows[-1]], df.schema)
    state = lambda d: checks.digest_state(d, ["k", "v"])
    after = checks.digest_of(checks.changed_state(state(df), added=state(added), gone=state(gone))).first()
    assert tuple(after) == digest(spark.createDataFrame([*rows[50:], (99, "z"), (99, "z"), rows[-1]], df.schema))
    assert digest(df.limit(0))[1] == 0 and digest(df.limit(0)) == tuple(checks.digest_of(checks.changed_state(state(gone), gone=state(gone))).first())
