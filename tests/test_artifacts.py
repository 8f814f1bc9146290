"""Artifacts, gates and text repair on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from evidara.functions import maps as P
from evidara.functions import text as T
from evidara.operators import artifacts as A
from evidara.operators import gates as G


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_text_repair(spark):
    assert one(spark, T.compose, "café ñ", "plain", None, "́") == ["café ñ", "plain", None, "́"]
    assert one(spark, T.normalize_text, "prevén-\ncion") == ["prevéncion"]
    assert one(spark, T.repair, "informaciÃ³n", "información", "Ã©€", "Â", None) == ["información", "información", "Ã©€", "Â", None]
    assert one(spark, T.slug, "  Ñandú / 5.1 ", "--", None) == ["nandu-5-1", "", None]
    assert one(spark, T.safe_path, "a/b.pdf", "/a", "a/../b", "c:x", "a\\b", "", None) == [True, False, False, False, False, False, False]
    assert one(spark, T.form_labels, "Nombre: ____\n Fecha de alta:__ x: y") == [["Nombre", "Fecha de alta"]]


def test_maps(spark):
    row = spark.range(1).select(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")).alias("l"), F.create_map(F.lit("b"), F.lit("3")).alias("r"))
    assert row.select(P.canonical_json(P.merged(F.col("l"), F.col("r")))).first()[0] == '{"a":"2","b":"3"}'
    assert one(spark, lambda x: P.typed(x, "doc"), "doc_0123456789abcdef", "doc_xyz", None) == [True, False, False]


def test_nested_html_tables(spark):
    html = "<p>x</p><table><tr><th>A<th>B</tr><tr><td>1 <table><tr><td>in</td></tr></table></td><td>2</td></tr><tr></tr>"
    got = A.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "no")], "k int, html string"), key="k").orderBy("table", "row").collect()
    assert [(r.k, r.table, r.row, r.header, r.cells) for r in got] == [(1, 0, 0, True, ["A", "B"]), (1, 0, 1, False, ["1", "2"]), (1, 1, 0, False, ["in"])]


def test_align(spark):
    docs = spark.createDataFrame([(1, "uno dos uno tres"), (2, None)], "d int, text string")
    pages = spark.createDataFrame([(1, 1, "dos"), (1, 2, "uno"), (1, 3, "tres"), (1, 4, "dos uno"), (1, 5, ""), (2, 1, "x")], "d int, page int, text string")
    got = A.align(pages, docs, "d").orderBy("d", "page").collect()
    assert [(r.start, r.reason) for r in got] == [(4, ""), (0, "not_unique"), (12, ""), (4, "out_of_order"), (None, "missing"), (None, "missing")]


def test_merge_regions(spark):
    pages = spark.createDataFrame([(1, "texto"), (2, None)], "p int, text string")
    regions = spark.createDataFrame([(1, 1, "nuevo"), (1, 2, "text"), (1, 3, "nuevo"), (2, 1, "solo")], "p int, ordinal int, text string")
    assert [r.text for r in A.merge_regions(pages, regions, ["p"]).orderBy("p").collect()] == ["texto\nnuevo", "solo"]


def test_checked_write(spark, tmp_path):
    path = str(tmp_path / "bundle")
    A.write_checked(spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "k int, t string, v double"), path, "k")
    assert A.damaged(spark, path, "k").count() == 0
    spark.createDataFrame([(2, "changed", 1.0), (3, "new", None)], "k int, t string, v double").write.mode("append").parquet(f"{path}/rows")
    assert sorted(r.k for r in A.damaged(spark, path, "k").collect()) == [2, 3]
    with pytest.raises(Exception, match="already exists"):
        A.write_checked(spark.range(1).withColumnRenamed("id", "k"), path, "k")


def test_responses_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(1, '{"fields":[{"name":"a","value":"1"}]}'), (2, "{"), (3, None), (4, '{"fields":[]}')], "k int, body string")
    assert [tuple(r) for r in A.response_fields(rows, "name string, value string", "k").collect()] == [(1, "a", "1")]


def test_ownership(spark):
    rows = [(1, 2, True, "p2"), (1, 1, False, "p1"), (1, 3, True, "p3"), (2, 1, True, None), (2, 2, None, None), (3, 1, True, "")]
    got = G.ownership(spark.createDataFrame(rows, "g int, ordinal int, readable boolean, project_id string"), "g").orderBy("g").collect()
    assert [(r.ownership, r.project_id) for r in got] == [("platform", "p2"), ("unverifiable", None), ("legacy", None)]


def test_call_order(spark):
    runs = {1: "classify parse extract", 2: "extract parse", 3: "parse extract classify", 4: "parse parse", 5: "parse classify classify", 6: "classify"}
    rows = [(k, i, s) for k, v in runs.items() for i, s in enumerate(v.split())]
    got = {r.run: r.reason for r in G.call_order(spark.createDataFrame(rows, "run int, position int, stop string"), "run").collect()}
    assert got == {1: "", 2: "extract_before_parse", 3: "classify_after_extract", 4: "not_one_parse", 5: "repeated", 6: "not_one_parse"}


def test_violations_and_reasons(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, -1, None)], "k int, n int, s string")
    assert sorted(tuple(r) for r in G.violations(rows, "k", positive=F.col("n") > 0, known=F.col("s") == "a").collect()) == [(2, "known"), (3, "positive")]
    assert [r[0] for r in rows.select(G.reasons(low=F.col("n") < 0, b=F.col("s") == "b")).collect()] == ["", "B", "LOW"]


def test_precedence(spark):
    docs = spark.createDataFrame([(1, 0.5, 0.4), (2, None, 0.4), (3, None, None), (4, None, None)], "document_id int, inventory double, metadata double")
    pages = spark.createDataFrame([(3, 0.2), (3, 0.4), (3, None), (4, None)], "document_id int, confidence double")
    got = G.first_measured(docs, pages, ["inventory", "metadata"]).orderBy("document_id").collect()
    assert [(r.kind, r.value and round(r.value, 6)) for r in got] == [("inventory", 0.5), ("metadata", 0.4), ("page_confidence_average", 0.3), ("unavailable", None)]
