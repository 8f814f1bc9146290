"""Stored artifacts, many patterns, composition: against plain Python."""

import json
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidara.operators import matching, unicode, versions


def read(spark, kind, *bodies, **kw):
    good, refused = versions.adapted(spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "artifact_id int, body string"), kind, **kw)
    return {r.artifact_id: r for r in good.collect()}, {r.artifact_id: r.reason for r in refused.collect()}


def test_unreadable_payloads_have_reasons(spark):
    old = {"schema_version": "1.0", "document_id": "d", "source_path": "/x/../a.pdf", "processing_status": "skipped", "page_count": "many"}
    good, refused = read(spark, "metadata", None, "", "{", "[]", "3", {"schema_version": "3.0"}, {"schema_version": "1.0"}, {"schema_version": "2.0", "document_id": "d", "source_relpath": "a"}, old)
    assert refused == {0: "invalid_json", 1: "invalid_json", 2: "invalid_json", 3: "unknown_version", 4: "unknown_version", 5: "unknown_version", 6: "missing_document_id", 7: "missing_status"}
    row = good[8]
    assert (row.status, row.source, row.page_count, row.document_type) == ("needs_review", "legacy/d/a.pdf", None, "otro") and row.warnings == [versions.SKIPPED, versions.OTHER_TYPE, versions.ABSOLUTE]


@pytest.mark.parametrize("path,want,note", [("a/b.pdf", "a/b.pdf", None), ("a\\b.pdf", "a/b.pdf", None), ("a//b", "legacy/d/b", versions.UNSAFE), ("./b", "legacy/d/b", versions.UNSAFE), ("", "legacy/d/n.pdf", versions.UNSAFE), ("/r/a/b", "a/b", None), ("/rx/b", "legacy/d/b", versions.ABSOLUTE), ("D:\\q\\b", "legacy/d/b", versions.ABSOLUTE), ("a/..", "legacy/d/n.pdf", versions.UNSAFE)])
def test_paths(spark, path, want, note):
    good, _ = read(spark, "inventory", {"schema_version": "1.0", "document_id": "d", "document_name": "n.pdf", "source_path": path, "processing_status": "processed"}, root="/r")
    assert good[0].source == want and good[0].warnings == ([note] if note else [])


def test_items(spark):
    good, refused = read(spark, "pages", {"schema_version": "1.0", "document_id": "d", "pages": [{"page_number": 1, "has_handwriting_warning": True}, {"text_raw": "x"}]}, {"schema_version": "2.0", "document_id": "e"}, {"schema_version": "2.0", "document_id": "f", "pages": []})
    assert refused == {0: "item_missing_page_number", 1: "no_items"} and set(good) == {0} and good[0].warnings == [versions.HANDWRITING]


@pytest.mark.parametrize("limit", (10**6, 2000))
def test_ten_thousand_terms(spark, limit):
    """Every hit and place, in one automaton and in several."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcé漢") for _ in range(n))
    terms = [(i, word(rng.randint(4, 7))) for i in range(10_000)] + [(20_000, "a"), (20_001, "a"), (20_002, ""), (20_003, None)]
    texts = [(i, 1, word(rng.randint(0, 120))) for i in range(20)] + [(99, 2, None)]
    got = matching.hits(spark.createDataFrame(texts, "document_id int, page_number int, text string"), spark.createDataFrame(terms, "term_id bigint, term string"), limit=limit)
    want = sorted((d, p, i, at) for d, p, t in texts if t for i, x in terms if x and x in t for at in range(len(t)) if t.startswith(x, at))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_anchors(spark):
    expected = spark.createDataFrame([(1, ["Uno  dos", "nada", ""]), (2, ["uno"]), (3, None)], "document_id int, anchors array<string>")
    pages = spark.createDataFrame([(1, 1, "x uno Uno dos"), (1, 2, "Uno\tdos"), (2, 1, "Uno dos"), (2, 2, None)], "document_id int, page_number int, text string")
    assert {(r.document_id, r.anchor): r.pages for r in matching.anchors(expected, pages).collect()} == {(1, "Uno  dos"): 2, (1, "nada"): 0, (1, ""): 0, (2, "uno"): 0}


def test_composition_of_all_characters_and_pairs_of_marks(spark):
    rng = random.Random(1)
    known = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    marks = [c for c in known if unicodedata.combining(c)]
    texts = ["".join(known[i : i + 50]) for i in range(0, len(known), 50)] + known[::97] + ["".join((rng.choice(known), rng.choice(marks), rng.choice(marks))) for _ in range(4000)] + ["\u1100\u1161\u11a8", "가\u11a8", "plain", "ñ", "n\u0303"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string")
    got = {r.id: r.text for r in unicode.composed(df, "text").collect()}
    assert got == {**{i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}, -1: None}
    sure = {r.id for r in df.where(unicode.surely_composed(F.col("text"))).collect()}
    assert all(unicodedata.is_normalized("NFC", texts[i]) for i in sure) and {texts.index("plain"), texts.index("ñ")} <= sure
