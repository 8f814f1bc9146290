"""Stored artifacts of two versions, anchors found by one automaton, composed texts: made from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import matching, unicode, versions
from evidara.plans.registry import query, table, texts



def _k():
    return F.col("o_orderkey")


def _c():
    return F.col("o_custkey")


def _status():
    return F.when(_c() % 3 == 0, "skipped").otherwise("processed")


_PATHS = ("docs/a.pdf", "/raw/docs/b.pdf", "/elsewhere/c.pdf", "../d.pdf", "C:\\raw\\e.pdf", "x\\f.pdf")


def _path():
    return F.get(F.array(*[F.lit(x) for x in _PATHS]), (_k() % len(_PATHS)).cast("int"))


def _name():
    return F.concat(F.lit("d"), _k().cast("string"))


def _payloads(spark, sf_dir, old, new):
    """Orders as payloads: every eleventh is no JSON, every thirteenth of an unknown version, every second of the old one."""
    text = F.when(_k() % 11 == 0, F.lit("{broken")).when(_k() % 2 == 0, F.to_json(F.struct(F.when(_k() % 13 == 0, "9.9").otherwise("1.0").alias("schema_version"), *old))).otherwise(F.to_json(F.struct(F.when(_k() % 13 == 0, "9.9").otherwise("2.0").alias("schema_version"), *new)))
    return table(spark, sf_dir, "orders").select(_k().alias("artifact_id"), text.alias("body"))


def _both(found, columns):
    good, refused = found
    shown = good.select("artifact_id", *columns, F.array_join("warnings", ",").alias("warnings"), F.lit("").alias("reason"))
    return shown.unionByName(refused.select("artifact_id", "reason"), allowMissingColumns=True)


_READ = "o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0"
_REASON = "CASE WHEN o_orderkey % 11 = 0 THEN 'invalid_json' WHEN o_orderkey % 13 = 0 THEN 'unknown_version' ELSE '' END AS reason"
_OLD = "o_orderkey % 2 = 0"
_SOURCE = """CASE WHEN NOT old THEN 'n/' || k || '.pdf' ELSE CASE k % 6 WHEN 0 THEN 'docs/a.pdf' WHEN 1 THEN 'docs/b.pdf' WHEN 2 THEN 'legacy/d' || k || '/c.pdf' WHEN 3 THEN 'legacy/d' || k || '/d.pdf' WHEN 4 THEN 'legacy/d' || k || '/e.pdf' ELSE 'x/f.pdf' END END"""
_PATH_NOTE = "CASE WHEN old AND k % 6 IN (2, 4) THEN 'legacy_absolute_path_not_relativized' WHEN old AND k % 6 = 3 THEN 'legacy_relative_path_unsafe' END"
_ROWS = f"SELECT o_orderkey AS k, o_custkey AS c, {_OLD} AS old, {_READ} AS fine, {_REASON} FROM orders"


@query(f"""
WITH r AS ({_ROWS})
SELECT k AS artifact_id, CASE WHEN fine THEN {_SOURCE} END AS source, CASE WHEN fine THEN CASE WHEN old AND c % 3 = 0 THEN 'needs_review' WHEN c % 3 = 0 THEN 'skipped' ELSE 'processed' END END AS status,
  CASE WHEN fine THEN CASE WHEN c % 4 <> 0 THEN 'manual' WHEN old THEN 'otro' ELSE 'receta' END END AS document_type, CASE WHEN fine THEN c % 9 END AS page_count, CASE WHEN fine THEN c % 10 / 10.0::DOUBLE END AS confidence, CASE WHEN fine AND NOT old THEN 'T' || k END AS title,
  CASE WHEN fine THEN concat_ws(',', CASE WHEN old AND c % 3 = 0 THEN 'legacy_skipped_status_mapped_to_needs_review' END, CASE WHEN old AND c % 4 = 0 THEN 'legacy_document_type_mapped_to_otro' END, {_PATH_NOTE}) END AS warnings, reason FROM r
""")
def artifact_metadata(spark, sf_dir):
    kind, score = F.when(_c() % 4 == 0, "receta").otherwise("manual"), _c() % 10 / 10.0
    old = [_name().alias("document_id"), F.lit("n.pdf").alias("document_name"), _path().alias("source_path"), F.lit("n/x.md").alias("normalized_path"), kind.alias("document_type"), (_c() % 9).alias("page_count"), score.alias("classification_confidence"), _status().alias("processing_status")]
    value = lambda c: F.struct(c.alias("value"))
    new = [_name().alias("document_id"), F.concat(F.lit("n/"), _k().cast("string"), F.lit(".pdf")).alias("source_relpath"), F.struct(kind.alias("document_type"), value(score).alias("document_type_confidence")).alias("classification")]
    new += [F.struct(value(F.concat(F.lit("T"), _k().cast("string"))).alias("title")).alias("document_control"), (_c() % 9).alias("page_count"), _status().alias("processing_status")]
    return _both(versions.adapted(_payloads(spark, sf_dir, old, new), "metadata", root="/raw"), ["source", "status", "document_type", "page_count", "confidence", "title"])


@query(f"""
WITH r AS ({_ROWS})
SELECT k AS artifact_id, CASE WHEN fine THEN {_SOURCE} END AS source, CASE WHEN fine THEN CASE WHEN old AND c % 3 = 0 THEN 'needs_review' WHEN c % 3 = 0 THEN 'skipped' ELSE 'processed' END END AS status, CASE WHEN fine AND c % 7 <> 0 THEN c END AS file_size,
  CASE WHEN fine THEN concat_ws(',', CASE WHEN old AND c % 3 = 0 THEN 'legacy_skipped_status_mapped_to_needs_review' END, {_PATH_NOTE}) END AS warnings, reason FROM r
""")
def artifact_inventory(spark, sf_dir):
    size = F.when(_c() % 7 != 0, _c().cast("string")).otherwise("unknown")  # a size that is no number is null
    old = [_name().alias("document_id"), F.lit("n.pdf").alias("document_name"), _path().alias("source_path"), size.alias("file_size"), _status().alias("processing_status")]
    new = [_name().alias("document_id"), F.concat(F.lit("n/"), _k().cast("string"), F.lit(".pdf")).alias("source_relpath"), size.alias("file_size"), _status().alias("processing_status")]
    return _both(versions.adapted(_payloads(spark, sf_dir, old, new), "inventory", root="/raw"), ["source", "status", "file_size"])


def _items(make):
    """As many items as the customer's number tells (0 to 2)."""
    return F.transform(F.sequence(F.lit(1), F.lit(2)), make)


_EACH = f"SELECT r.*, i FROM ({_ROWS}) r, unnest(range(1, 3)) AS u(i) WHERE fine"


@query(f"""
SELECT k AS artifact_id, CAST(i AS BIGINT) AS page_number, 't' || i AS text_raw, c % 10 / 10.0::DOUBLE AS confidence, CASE WHEN old AND c % 2 = 0 THEN 'legacy_handwriting_warning_unverified' ELSE '' END AS warnings, reason FROM ({_EACH})
UNION ALL SELECT k, NULL, NULL, NULL, NULL, reason FROM ({_ROWS}) WHERE NOT fine
""")
def artifact_pages(spark, sf_dir):
    old = _items(lambda i: F.struct(i.alias("page_number"), F.concat(F.lit("t"), i.cast("string")).alias("text_raw"), (_c() % 10 / 10.0).alias("ocr_confidence"), (_c() % 2 == 0).alias("has_handwriting_warning")))
    new = _items(lambda i: F.struct(i.alias("page_number"), F.concat(F.lit("t"), i.cast("string")).alias("text_raw"), F.struct((_c() % 10 / 10.0).alias("value")).alias("ocr_confidence")))
    rows = _payloads(spark, sf_dir, [_name().alias("document_id"), old.alias("pages")], [_name().alias("document_id"), new.alias("pages")])
    return _both(versions.adapted(rows, "pages"), ["page_number", "text_raw", "confidence"])


@query(f"""
SELECT k AS artifact_id, 'tess' AS engine, CAST(i AS BIGINT) AS page_number, CASE WHEN c % 2 = 0 THEN CAST(c % 360 AS DOUBLE) END AS rotation, CASE WHEN NOT old THEN 'measured' WHEN c % 2 = 0 THEN 'estimated' ELSE 'unavailable' END AS rotation_status,
  CASE WHEN old AND c % 2 = 0 THEN 'legacy_rotation_not_measured' ELSE '' END AS warnings, reason FROM ({_EACH})
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, reason FROM ({_ROWS}) WHERE NOT fine
""")
def artifact_ocr(spark, sf_dir):
    turn = F.when(_c() % 2 == 0, _c() % 360)
    old = _items(lambda i: F.struct(i.alias("page_number"), turn.alias("rotation_detected_degrees")))
    new = _items(lambda i: F.struct(i.alias("page_number"), F.struct(turn.alias("value"), F.lit("measured").alias("status")).alias("rotation")))
    rows = _payloads(spark, sf_dir, [_name().alias("document_id"), F.lit("tess").alias("engine"), old.alias("pages")], [_name().alias("document_id"), F.lit("tess").alias("engine"), new.alias("pages")])
    return _both(versions.adapted(rows, "ocr"), ["engine", "page_number", "rotation", "rotation_status"])


@query(f"""
SELECT k AS artifact_id, CASE WHEN c % 5 = 0 AND i = 2 THEN NULL ELSE 'T' || i END AS table_id, CASE WHEN c % 5 = 0 AND i = 2 THEN NULL ELSE 'a|b' END AS headers, CASE WHEN c % 5 = 0 AND i = 2 THEN NULL ELSE CAST(c AS VARCHAR) END AS cell,
  CASE WHEN c % 5 = 0 AND i = 2 THEN NULL WHEN old THEN 'legacy_v1' ELSE 'vector' END AS extractor, CASE WHEN c % 5 = 0 AND i = 2 THEN NULL WHEN old THEN 'legacy_geometry_unavailable' ELSE '' END AS warnings, CASE WHEN c % 5 = 0 AND i = 2 THEN 'item_missing_table_id' ELSE '' END AS reason FROM ({_EACH})
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, reason FROM ({_ROWS}) WHERE NOT fine
""")
def artifact_tables(spark, sf_dir):
    """Every fifth customer's second table has no id."""
    name = lambda i: F.when(~((_c() % 5 == 0) & (i == 2)), F.concat(F.lit("T"), i.cast("string")))
    cells = F.array(F.array(_c().cast("string"), F.lit("x")))
    old = _items(lambda i: F.struct(name(i).alias("table_id"), i.alias("page_number"), F.array(F.lit("a"), F.lit("b")).alias("headers"), cells.alias("rows")))
    new = _items(lambda i: F.struct(name(i).alias("table_id"), i.alias("page_number"), F.array(F.lit("a"), F.lit("b")).alias("headers"), cells.alias("rows"), F.lit("vector").alias("extractor")))
    good, refused = versions.adapted(_payloads(spark, sf_dir, [_name().alias("document_id"), old.alias("tables")], [_name().alias("document_id"), new.alias("tables")]), "tables")
    good = good.withColumn("headers", F.array_join("headers", "|")).withColumn("cell", F.col("rows")[0][0])
    return _both((good, refused), ["table_id", "headers", "cell", "extractor"])


@query("""
WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark), w AS (SELECT term FROM t WHERE length(term) >= 5)
SELECT d.doc_id, w.term, min(strpos(d.text, w.term)) - 1 AS first FROM documents d JOIN w ON contains(d.text, w.term) GROUP BY d.doc_id, w.term
""")
def term_hits(spark, sf_dir):
    """The benchmark's longer words in all documents, each with its first place."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).where(F.length("term") >= 5).distinct().withColumn("term_id", F.xxhash64("term"))
    found = matching.hits(texts(spark, sf_dir), words, key=("doc_id",))
    return found.groupBy("doc_id", "term_id").agg(F.min("start").alias("first")).join(words, "term_id").select("doc_id", "term", "first")


_MARKS = (0x301, 0x323, 0x327, 0x308, 0x1161, 0x11A8, 0x93C, 0x3099)
_BASES = (0x61, 0x41, 0x63, 0x6F, 0x1100, 0xAC00, 0x928, 0x304B, 0x212B, 0x1EA1, 0x391)


@query(f"""
WITH t AS (SELECT o_orderkey, chr({list(_BASES)}[o_orderkey % {len(_BASES)} + 1]) || CASE WHEN o_custkey % 5 = 0 THEN '' ELSE chr({list(_MARKS)}[o_custkey % {len(_MARKS)} + 1]) || chr({list(_MARKS)}[o_orderkey // 8 % {len(_MARKS)} + 1]) END || 'x' AS text FROM orders)
SELECT o_orderkey, nfc_normalize(text) AS text FROM t
""")
def composed_texts(spark, sf_dir):
    """Letters of several scripts with two marks, or none."""
    letter = lambda values, at: F.get(F.array(*[F.lit(chr(x)) for x in values]), (at % len(values)).cast("int"))
    marks = F.when(_c() % 5 == 0, "").otherwise(F.concat(letter(_MARKS, _c()), letter(_MARKS, F.floor(_k() / 8))))
    return unicode.composed(table(spark, sf_dir, "orders").select("o_orderkey", F.concat(letter(_BASES, _k()), marks, F.lit("x")).alias("text")), "text")
