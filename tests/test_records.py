"""JSON lines with reasons, packed groups, repaired and folded values."""

import json

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import engines, markdown, structure
from evidara.sources import records


def put(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return f"file://{path}"


def reasons(refused):
    return sorted(r.reason for r in refused.collect())


def test_chunks(spark, tmp_path):
    parent = lambda i, d="d1", **kw: {"chunk_id": f"p{i}", "document_id": d, "ordinal": i, "text": f"parent {i}", **kw}
    child = lambda i, p, d="d1", **kw: {"chunk_id": f"c{i}", "parent_id": p, "document_id": d, "ordinal": i, "text": "t", "token_count": 3, **kw}
    ups = put(tmp_path / "parents.jsonl", parent(1), parent(1), "", "{broken", parent(2, text=None), parent(3), parent(4), parent(4, ordinal=9), "[1]")
    downs = put(tmp_path / "children.jsonl", child(2, "p1"), child(1, "p1"), child(3, "p2"), child(4, "p3", "other"), child(5, None), child(6, "p3", more=1))
    up, down, refused = records.chunks(spark, ups, downs)
    assert sorted(r.chunk_id for r in up.collect()) == ["p1", "p3"]
    assert {(r.chunk_id, r.parent_text, r.parent_ordinal) for r in down.collect()} == {("c1", "parent 1", 1), ("c2", "parent 1", 1), ("c6", "parent 3", 3)}
    assert reasons(refused) == sorted(["invalid_json", "missing_text", "repeated_key", "repeated_key", "invalid_json", "unknown_parent", "parent_of_other_document", "missing_parent_id"])
    assert {r.parent_id: r.children for r in records.children_of(down, up).collect()} == {"p1": ["c1", "c2"], "p3": ["c6"]}
    assert records.children_of(down.where("false"), up).count() == 2


def test_questions_golden_and_decisions(spark, tmp_path):
    asked = put(tmp_path / "q.jsonl", {"question_id": "q1", "question": "¿x?", "relevant_document_ids": ["d1"], "expected_page": 1}, {"question_id": "q2", "question": "y"}, {"question_id": "q3", "question": "z", "relevant_document_ids": "d1"})
    good, refused = records.read(spark, asked, records.QUESTIONS)
    assert [r.question_id for r in good.collect()] == ["q1"] and set(reasons(refused)) <= {"missing_relevant_document_ids", "invalid_json"} and refused.count() == 2
    told = put(tmp_path / "d.jsonl", {"document_id": "d", "decision": "approved", "decided_at": "2024-01-01T00:00:00"}, {"document_id": "d", "decision": "perhaps", "decided_at": "2024-01-02T00:00:00"}, {"document_id": "d", "decision": "rejected"})
    good, refused = records.read(spark, told, records.DECISIONS)
    assert [r.decision for r in good.collect()] == ["approved"] and reasons(refused) == ["bad_decision", "missing_decided_at"]
    gold = put(tmp_path / "g.jsonl", {"document_id": "d", "source_relpath": "a.pdf", "page_count": 2, "expected": {"title": "T"}, "anchors": ["x"]}, {"document_id": "e", "source_relpath": "b.pdf", "page_count": "two"})
    good, refused = records.read(spark, gold, records.GOLDEN)
    assert [(r.document_id, r.expected, r.anchors) for r in good.collect()] == [("d", {"title": "T"}, ["x"])] and refused.count() == 1
    assert records.read(spark, put(tmp_path / "e.jsonl", ""), records.GOLDEN)[0].count() == 0


def test_groups_of_long_arrays(spark):
    import random

    rng = random.Random(2)
    sizes = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 50, 20_000)]
    want = []
    for row in sizes:
        g, n, out = 0, 0, []
        for i, x in enumerate(row):
            if i and n + x > 12:
                g, n = g + 1, 0
            n += x
            out.append(g)
        want.append(out)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(sizes)], "i int, r array<int>")
    assert [r.g for r in df.select("i", structure.pack(F.col("r"), lambda x: x, 12).alias("g")).orderBy("i").collect()] == want


def test_texts_misread_twice(spark):
    rows = [("Política", "Política"), ("PolÃ­tica", "Política"), ("Política".encode().decode("latin-1").encode().decode("latin-1"), "Política"), ("Ã", "Ã"), ("â", "â"), ("Ã­ € ", "Ã­ € "), (None, None), ("", "")]
    got = [r.x for r in spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, t string").select("i", T.repaired(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [b for _, b in rows]
    value = lambda x, field="": spark.range(1).select(T.golden_value(F.lit(x), field)).first()[0]
    assert value(" GUÍA  de\tuso") == "guia de uso" and value("PR - SST.01", "document_code") == "prsst01" and value("Título .:;", "title") == "titulo" and value("ño") == "no"


def test_engines_are_parameters(spark):
    df = spark.createDataFrame([(1, "uno dos"), (2, ""), (3, None), (4, "..."), (5, "uno dos")], "node_id int, text string")
    got = {r.node_id: r for r in engines.embedded(df, engines.worded(16)).collect()}
    assert [got[i].reason for i in range(1, 6)] == ["", "no_text", "no_text", "", ""] and got[1].embedding == got[5].embedding and abs(sum(x * x for x in got[1].embedding) - 1) < 1e-6 and set(got[4].embedding) == {0.0}
    own = engines.Engine("me", "odd", "2", 2, lambda t: F.when(t == "...", F.array(F.lit(1.0))).when(F.length(t) == 7, F.array(F.lit(1.0), F.lit(float("nan")))))
    assert {r.node_id: r.reason for r in engines.embedded(df, own).collect()} == {1: "not_finite", 2: "no_text", 3: "no_text", 4: "dimension", 5: "not_finite"}


def test_tokenizers_are_parameters(spark):
    docs = spark.createDataFrame([(1, "Uno. Dos dos. Tres tres tres. Cuatro.")], "doc_id int, text string")
    profile = structure.Profile(4, 8, 12, 0.12, 1, 3)
    by_words, by_letters = (structure.sentence_chunks(docs, profile, **kw).collect() for kw in ({}, {"count": len}))
    assert [len(by_words), len(by_letters), by_words[0].token_count, by_letters[0].token_count] == [1, 4, 7, 4]
    blocks = spark.createDataFrame([(1, i, "text", "a b c", 0, 1, None, None) for i in range(4)], "document_id int, ordinal int, kind string, text string, char_start int, char_end int, page_start int, page_end int")
    assert [markdown.parents(blocks, 6, count=f).count() for f in (markdown.tokens, lambda t: F.length(t))] == [2, 4]
