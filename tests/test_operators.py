"""Small hand-computed frames for the operators."""

import pytest
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.functions import vectors as V
from evidara.operators import lanes, ledger, retrieval, structure
from evidara.sources import files
from evidara.streaming import ledger as streaming


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_normalize_text(spark):
    raw = "preven-\ncion\x00  de\r\nriesgos \n\n\n\n fin  "
    assert spark.range(1).select(T.normalize_text(F.lit(raw))).first()[0] == "prevencion de\nriesgos\n\nfin"


def test_rrf_order_and_sources(spark):
    lists = spark.createDataFrame([("vector", 1, "n1"), ("vector", 2, "n2"), ("lexical", 1, "n2"), ("lexical", 2, "n3")], "source string, rank int, node_id string")
    got = retrieval.rrf(lists).orderBy(F.desc("score"), "node_id")
    assert values(got, "node_id", "sources") == [("n2", "lexical,vector"), ("n1", "vector"), ("n3", "lexical")]


def test_vector_metrics(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    row = spark.range(1).select(V.score(a, b, "cosine"), V.score(a, b, "l2"), V.score(a, b, "inner_product"), V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert (row[0], round(row[1], 6), row[2], row[3]) == (0.0, round(1 - 5**0.5, 6), 1.0, 0.0)


def test_hit_rates(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x")], "query_id int, rank int, node_id string")
    relevant = spark.createDataFrame([(1, "c")], "query_id int, relevant_id string")
    row = retrieval.hit_rates(ranked, relevant, 3).first()
    assert (row.recall_at_k, row.mrr) == (0.5, 0.166667)


def test_rollback_undoes_activation(spark):
    rows = spark.createDataFrame(
        [(1, "p", "f", "d1", "b0", True, None), (2, "p", "f", "d1", "b1", False, None), (3, "p", "f", "d2", "b0", True, None)],
        "node_id int, project_id string, profile_id string, document_id string, bundle_id string, is_active boolean, superseded_at timestamp",
    )
    active = lanes.activate(rows, "b1", "2026-01-01 00:00:00").orderBy("node_id")
    assert values(active, "node_id", "is_active") == [(1, False), (2, True), (3, True)]
    assert values(lanes.rollback(active, "b1", "b0", "2026-01-02 00:00:00").orderBy("node_id"), "node_id", "is_active") == [(1, True), (2, False), (3, True)]


def test_sealed_rows_stay(spark):
    old = spark.createDataFrame([(1, "sealed", 1), (2, "writing", 1)], "id int, status string, version int")
    new = spark.createDataFrame([(1, "sealed", 2), (2, "sealed", 2), (3, "writing", 2)], "id int, status string, version int")
    after, refused = lanes.seal_once(old, new, "id")
    assert values(after.orderBy("id"), "id", "version") == [(1, 1), (2, 2), (3, 2)]
    assert values(refused, "id") == [(1,)]


def test_idempotency(spark):
    rows = spark.createDataFrame([("k", "f", 1, 1), ("k", "f", 2, 2), ("k", "g", 3, 3), ("l", "f", 1, 4)], "key string, fingerprint string, at int, request_id int")
    assert values(ledger.idempotency(rows).orderBy("request_id"), "outcome") == [("fresh",), ("replay",), ("conflict",), ("fresh",)]


def test_packing_keeps_the_limit_and_the_order(spark):
    df = spark.createDataFrame([(["aaa", "bb", "c", "dddddd", "e"],)], "lines array<string>")
    assert df.select(structure.pack(F.col("lines"), lambda x: F.length(x), 5)).first()[0] == [0, 0, 1, 2, 3]


def test_heading_path_resets_below(spark):
    rows = [("d", 0, 1, "A"), ("d", 1, 2, "a"), ("d", 2, None, "text"), ("d", 3, 1, "B"), ("d", 4, None, "text")]
    got = structure.heading_path(spark.createDataFrame(rows, "document_id string, ordinal int, level int, text string"), 2).orderBy("ordinal")
    assert values(got, "heading_path") == [("A",), ("A > a",), ("A > a",), ("B",), ("B",)]


@pytest.mark.parametrize("text", ["", "One. Two! Three?", " ".join(f"Word{i} " * 7 + "end." for i in range(60))])
def test_sentence_chunks_cover_the_text(spark, text):
    profile = structure.Profile(20, 30, 50, 0.12, 4, 12)
    chunks = structure.sentence_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), profile).orderBy("ordinal").collect()
    own = [c.text.split() for c in chunks]
    whole, seen = text.split(), []
    for words in own:
        # what a chunk repeats is a suffix of what came before
        k = next(n for n in range(min(len(words), len(seen)), -1, -1) if seen[len(seen) - n :] == words[:n])
        seen += words[k:]
        assert k <= profile.overlap_max
    assert seen == whole


def test_inventory_markdown_and_ledger(spark, tmp_path):
    (tmp_path / "in" / "cat").mkdir(parents=True)
    (tmp_path / "in" / "cat" / "a.MD").write_text("x")
    (tmp_path / "in" / "cat" / "b").write_bytes(b"%PDF-1.4")
    (tmp_path / "in" / "c.md").write_text("---\ntitle: T: x\n---\nbody")
    got = {r.relpath: (r.extension, r.category, r.size) for r in files.inventory(spark, f"file://{tmp_path}/in").collect()}
    assert got == {"cat/a.MD": ("md", "cat", 1), "cat/b": ("pdf", "cat", 8), "c.md": ("md", "", 24)}
    row = files.markdown(spark, f"file://{tmp_path}/in").where("relpath = 'c.md'").first()
    assert (row.front["title"], row.body, row.warning) == ("T: x", "body", "missing_title")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, f"file://{tmp_path}/l.jsonl", "a int").collect()) == [1, 2]
    assert files.write_sealed(spark.range(3), f"file://{tmp_path}/s") and not files.write_sealed(spark.range(9), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.usage_by_window(streaming.events_stream(spark, f"{tmp_path}/in", events.schema))
    query = stream.writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in streaming.usage_by_window(events).select("start", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("usage").select("start", "event_type", "n").collect()} == want
