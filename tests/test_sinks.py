"""Sinks: readers see the old or the new, never half; promotion needs validation; sidecars must fit."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evidara.operators import selection as S
from evidara.sources import sinks


def test_manifests_are_replaced_whole(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    df = spark.createDataFrame([("a", None), ("b", "x")], "document_id string, error string")
    sinks.write_manifests(root, generated_at="2024-01-01", run_id="r1", inventory=df, errors=df.where("error is not null"))
    sinks.write_manifests(root, generated_at="2024-01-02", run_id="r2", inventory=df.limit(1))
    inventory = spark.read.json(f"{root}/inventory").collect()
    assert [(r.schema_version, r.run_id) for r in inventory] == [("2.0", "r2")]
    assert spark.read.json(f"{root}/errors").count() == 1 and not any(x.startswith(".") and x.endswith("staged") for x in os.listdir(tmp_path / "m"))


def test_stored_responses_hold_no_secrets(spark, tmp_path):
    body = json.dumps({"token": "a\"b", "deep": [{"URL": "http://x", "n": 1}], "text": "see https://x", "link": "https://x/y?sig=1"})
    df = spark.createDataFrame([("d", "h/1", "parse", body)], "document_id string, configuration_hash string, capability string, body string")
    sinks.write_responses(df, f"file://{tmp_path}/r")
    row = spark.read.parquet(f"file://{tmp_path}/r").first()
    assert json.loads(row.body) == {"token": "***redacted***", "deep": [{"URL": "***redacted***", "n": 1}], "text": "see https://x", "link": "***redacted***"} and row.configuration_hash == "h_1"


def test_vectors_go_live_only_whole(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "node_id long, embedding array<float>")
    sinks.promote_vectors(spark, sinks.stage_vectors(good, root), root, 2)
    bad = spark.createDataFrame([(3, [1.0])], "node_id long, embedding array<float>")
    with pytest.raises(ValueError):
        sinks.promote_vectors(spark, sinks.stage_vectors(bad, root), root, 2)
    assert spark.read.parquet(root).count() == 2
    odd = good.unionByName(spark.createDataFrame([(4, [float("nan"), 1.0]), (5, None), (6, [None, 1.0])], "node_id long, embedding array<float>"))
    odd.write.parquet(f"file://{tmp_path}/w")
    fine, refused = sinks.vectors(spark, f"file://{tmp_path}/w", 2)
    assert {r.node_id for r in fine.collect()} == {1, 2} and {r.node_id for r in refused.collect()} == {4, 5, 6}


def test_promotion_needs_validation(spark, tmp_path):
    live, candidate = tmp_path / "live", tmp_path / "candidate"
    live.mkdir(), candidate.mkdir()
    (live / "a").write_text("old"), (candidate / "b").write_text("new")
    with pytest.raises(ValueError):
        sinks.promote(spark, f"file://{candidate}", f"file://{live}", structural_status="failed")
    assert (live / "a").read_text() == "old"
    sinks.promote(spark, f"file://{candidate}", f"file://{live}", structural_status="passed")
    assert (live / "b").read_text() == "new" and not (live / "a").exists() and (candidate / "b").exists() and not (tmp_path / "live.backup").exists()
    with pytest.raises(ValueError):
        sinks.promote(spark, f"file://{tmp_path}/none", f"file://{live}", structural_status="passed")


def test_documents_with_sidecars(spark):
    bodies = spark.createDataFrame([("a", "# x", "h1"), ("b", "# y", "h2"), ("c", "", "h3"), ("d", "# z", "h4")], "document_id string, markdown string, content_hash string")
    side = lambda rows: spark.createDataFrame(rows, "document_id string, content_hash string, payload string")
    good, refused = sinks.normalized_documents(bodies, {"metadata": side([("a", "h1", "m"), ("b", "old", "m"), ("c", "h3", "m"), ("z", "h9", "m")])}, {"tables": side([("a", "h1", "t")])})
    assert [(r.document_id, r.metadata, r.tables, r.tables_present) for r in good.collect()] == [("a", "m", "t", True)]
    assert {(r.document_id, r.reason) for r in refused.collect()} == {("b", "other_content_metadata"), ("c", "empty_body"), ("d", "missing_metadata"), ("z", "orphan_sidecar")}


def test_media_types(spark):
    assert [r.m for r in spark.createDataFrame([("PDF",), ("xyz",)], "e string").select(sinks.media_type(F.col("e")).alias("m")).collect()] == ["application/pdf", "application/octet-stream"]


def test_lists_of_any_length(spark):
    df = spark.range(3000)
    assert S.among(df, "id", range(0, 3000, 2)).count() == 1500 and S.among(df, "id", [1, 2]).count() == 2 and S.among(df, "id", []).count() == 0 and S.among(df, "id", None).count() == 3000
    assert S.only_sources(spark.createDataFrame([("a",), ("b",)], "source_relpath string"), ["a", "q"])[1] == ["q"]
