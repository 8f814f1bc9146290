"""Rules on hand-made rows: nulls, ties and empty frames of classification, control fields, merges, joins by bins, invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import checks, classify, control, documents, invariants, lanes, platforms, retrieval, selection, structure


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_classes_of_nothing_and_ties(spark):
    evidence = rows(spark, [(1, "content", None), (1, "route", "manual/acta"), (2, "content", "un MANUAL de formato"), (3, "other", "politica")], "document_id long, source string, text string")
    got = {r.document_id: r for r in classify.classify(evidence).collect()}
    assert (got[1].document_type, got[1].type_source, got[1].warnings, got[1].topic) == ("manual", "route", "route_only_low_confidence", "SST")
    assert (got[2].document_type, got[2].topic, got[2].content_prediction) == ("formulario", "Formularios", "formulario")
    assert (got[3].document_type, got[3].type_confidence, got[3].subtopic) == ("politica", 0.35, None)
    assert classify.classify(evidence.limit(0)).count() == 0


def test_control_fields(spark):
    lines = [
        (1, 1, 0, "<td>Código</td><td>gh . sst - 01</td>"), (1, 1, 1, "código: AB-CD-99"), (1, 1, 2, "versión [o3]"), (1, 2, 3, "versión 7"), (1, 1, 4, None), (1, 1, 5, "REGLAMENTO COMITÉ DE CONVIVENCIA LABORAL"),
        (2, 1, 0, "nada"), (3, 1, 0, "ab.cd-12"), (3, 1, 1, " sst "), (3, 1, 2, "versión 1.0"), (3, 1, 3, "versión 2.0"), (3, 1, 4, "# Contenido"), (3, 2, 5, "# Guía de uso"), (3, 1, 6, "vigencia: 2024/3/1"),
    ]
    got = {(r.document_id, r.field): (r.status, r["values"]) for r in control.fields(rows(spark, lines, "document_id long, page int, line_no int, line string")).collect()}
    assert got[1, "code"] == ("extracted", "GH.SST-01") and got[1, "version"] == ("extracted", "0.3")
    assert got[1, "title"] == ("extracted", "REGLAMENTO DEL COMITÉ DE CONVIVENCIA LABORAL")
    assert {got[2, f][0] for f in control.FIELDS} == {"not_found"}
    assert got[3, "code"] == ("extracted", "AB.CD-12 SST") and got[3, "version"] == ("conflicting", "1.0|2.0") and got[3, "title"][1] == "Guía de uso" and got[3, "effective_date"][1] == "2024-03-01"
    assert control.fields(rows(spark, [], "document_id long, page int, line_no int, line string")).count() == 0


def test_control_values_keep_to_their_grammar(spark):
    lines = [
        "Código: PR-5ST | Versión: [02]", "codigo # GH - PS - 001 SST", "CÓDIGO seguridad", "code: abcde-1", "Código: A-123456789", "ver. o3", "Versión 1,2.3 de junio", "versión de los incidentes", "conversión: 7",
        "Fecha de emisión: 5 de marzo de 2021.", "publicación - 3 días del mes de abril de 2020", "emisión sin fecha", "firmado en Bogotá el 2 de mayo de 2019", "Vigencia: 2024-1-9", "ref AB.CD-12-XYZ y ab-cd-12ef", "Julio 2018", "Juliol 2018",
    ]
    got = {}
    for r in control.candidates(rows(spark, [(i, 1, i, x) for i, x in enumerate(lines)], "document_id long, page int, line_no int, line string")).collect():
        got.setdefault(r.document_id, []).append((r.field, r.rank, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [("code", 1, "PR-5ST"), ("version", 0, "0.2")], 1: [("code", 1, "GH-PS-001 SST"), ("code", 2, "GH-PS-001 SST")], 5: [("version", 0, "0.3")], 6: [("version", 0, "1.2.3")],
        9: [("publication_date", 0, "2021-03-05")], 10: [("publication_date", 0, "2020-04-03")], 12: [("publication_date", 1, "2019-05-02")], 13: [("effective_date", 0, "2024-01-09")],
        14: [("code", 2, "AB-CD-12EF"), ("code", 2, "AB.CD-12-XYZ")], 15: [("publication_date", 2, "2018-07")],
    }


def test_titles_go_on_in_the_next_line(spark):
    docs = {
        1: ["OBJETIVOS Y METAS", "", "SEGURIDAD VIAL"], 2: ["Política de", "texto corriente"], 3: ["REGLAMENTO ANTE", "UNO DOS TRES CUATRO CINCO SEIS SIETE"], 4: ["COPIA CONTROLADA", "# Manual de", "NORMAS GENERALES"], 5: ["MANUAL DEL", "FORMATO UNO"],
    }
    lines = [(d, 1, i, x) for d, t in docs.items() for i, x in enumerate(t)] + [(6, 1, 0, "GUÍA DE"), (6, 2, 1, "BUENAS PRÁCTICAS")]
    got = {r.document_id: r.value for r in control.titles(rows(spark, lines, "document_id long, page int, line_no int, line string")).collect()}
    assert got == {1: "OBJETIVOS Y METAS DE SEGURIDAD VIAL", 2: "Política de", 3: "REGLAMENTO ANTE", 4: "Manual de", 5: "MANUAL DEL", 6: "GUÍA DE"}


def test_rollback_leaves_other_bundles(spark):
    schema = "project_id string, profile_id string, document_id int, bundle_id string, is_active boolean, superseded_at timestamp"
    vectors = rows(spark, [("p", "f", 1, "old", False, None), ("p", "f", 1, "new", True, None), ("p", "f", 2, "old", False, None), ("p", "f", 2, "new", False, None), ("p", "f", 2, "third", True, None), ("q", "f", 1, "new", True, None)], schema)
    got = {(r.project_id, r.document_id, r.bundle_id): r.is_active for r in lanes.rollback(vectors, "new", "old", "2024-01-01").collect()}
    assert got == {("p", 1, "old"): True, ("p", 1, "new"): False, ("p", 2, "old"): False, ("p", 2, "new"): False, ("p", 2, "third"): True, ("q", 1, "new"): True}


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    old, new = rows(spark, [(1, 0, "a"), (2, 0, "b")], "k int, at int, v string"), rows(spark, [(1, 1, "c"), (1, 3, "d"), (1, 2, "e")], "k int, at int, v string")
    assert sorted(map(tuple, lanes.upsert(old, new, ["k"], "at").collect())) == [(1, 3, "d"), (2, 0, "b")]


def test_null_page_numbers_break_the_order(spark):
    df = rows(spark, [(1, 1), (1, 2), (2, 1), (2, None)], "d int, n int")
    assert [r.d for r in checks.contiguous(df, ["d"], "n").collect()] == [2]


def test_joins_by_bins_are_the_joins_by_distance(spark):
    rng = np.random.default_rng(1)
    a = [(i, int(i % 3), float(x)) for i, x in enumerate(rng.uniform(-50, 50, 60))]
    b = [(i, int(i % 3), float(x)) for i, x in enumerate(np.round(rng.uniform(-50, 50, 60)))]
    left, right = rows(spark, a, "i int, k int, x double"), rows(spark, b, "j int, k int, y double")
    want = {}
    for i, k, x in a:
        near = sorted((abs(x - y), j) for j, m, y in b if m == k and abs(x - y) <= 7)
        if near:
            want[i] = near[0][1]
    assert {r.i: r.j for r in structure.nearest_within(left, right, on=["k"], left_value="x", right_value="y", within=7, left_key="i", right_key="j").collect()} == want
    pairs = {(i, j) for i, k, x in a for j, m, y in a if k == m and x < y <= x + 7}
    assert {tuple(r) for r in structure.starts_within(left, on=["k"], at="x", key="i", within=7).collect()} == pairs


@pytest.mark.parametrize("seed", range(4))
def test_child_starts_by_trying_each(seed):
    """A child ends before the first sentence at which its rule says so."""
    rng = np.random.default_rng(seed)
    for _ in range(200):
        counts = rng.integers(1, 40, rng.integers(1, 30))
        upto = np.concatenate([[0], np.cumsum(counts)])
        least, goal, most = sorted(rng.integers(1, 90, 3).tolist())
        starts, held = [0], 0
        for i, n in enumerate(counts):
            if i and held >= least and (held >= goal or held + n > most):
                starts.append(i)
                held = 0
            held += n
        last = starts[-1]
        if len(starts) > 1 and upto[-1] - upto[last] < least and upto[-1] - upto[starts[-2]] <= most:
            starts.pop()
        assert structure.child_starts(upto, least, goal, most) == starts


def test_sentences_know_where_they_stand(spark):
    text = "  Uno dos. Tres?  Cuatro!\n\n \n Cinco seis.\n"
    assert [text[a:b] for a, b in structure.sentence_spans(text)] == ["Uno dos.", "Tres?", "Cuatro!", "Cinco seis."]
    got = structure.sentence_chunks(rows(spark, [(1, text), (2, None), (3, " ")], "doc_id long, text string"), structure.Profile(2, 3, 4, 0.1, 1, 1)).collect()
    assert all(" ".join(text[r.char_start : r.char_end].split()) == r.text for r in got) and {r.doc_id for r in got} == {1}


def test_checks_without_rows(spark):
    checked = invariants.activation(
        rows(spark, [(1, 1, 1, "sealed", 0, "l2", True), (2, None, None, None, None, None, None)], "bundle_id int, profile_id int, target_id int, status string, vector_count int, distance_metric string, checksums_verified boolean"),
        rows(spark, [], "bundle_id int, run_status string, validation_status string, vector_rows int, child_nodes int"), rows(spark, [], "target_id int, target_active boolean, target_table string, metrics array<string>"), rows(spark, [], "profile_id int, vector_table string"),
    )
    got = {r.bundle_id: r.failed for r in invariants.blocked(checked, "bundle_id").collect()}
    assert got == {1: "indexing_run_completed,indexing_target_compatible", 2: "artifact_checksums_match,embedding_bundle_sealed,indexing_run_completed,indexing_target_compatible,node_and_vector_counts_match"}


def test_bounded_pages(spark):
    df = spark.range(200)
    first, total = platforms.page(df, [F.desc("id")])
    assert [r.id for r in first.collect()] == list(range(199, 174, -1)) and total.first().total == 200
    assert [r.id for r in platforms.page(df, [F.col("id")], limit=2, offset=199)[0].collect()] == [199]
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            platforms.page(df, [F.col("id")], **bad)


def test_claims_take_pending_rows_once(spark):
    queue = rows(spark, [(1, "pending", None, None), (2, "running", "w0", None), (3, "pending", None, None)], "run_id int, status string, worker string, claimed_at timestamp")
    after, claimed = selection.claim(queue, rows(spark, [(1,), (1,), (2,), (9,)], "run_id int"), "w1", "2024-01-01")
    assert [r.run_id for r in claimed.collect()] == [1] and {r.run_id: r.worker for r in after.collect()} == {1: "w1", 2: "w0", 3: None}
    assert selection.claim(after, claimed, "w2", "2024-01-02")[1].count() == 0


def test_tables_and_errors_as_text(spark):
    df = rows(spark, [([["a", "b|c"], ["1"], [None, "x\ny"]],), ([],), ([[]],)], "r array<array<string>>")
    assert [r.t for r in df.select(documents.render_table(F.col("r")).alias("t")).collect()] == ["| a | b\\|c |\n| --- | --- |\n| 1 |  |\n|  | x y |", "", ""]
    shown = rows(spark, [("open C:\\tmp\\x failed, see https://h/y?sig=1 or /var/lib/a",)], "t string").select(T.error_text(F.col("t")).alias("t")).first().t
    assert shown == "open ***redacted*** failed, see ***redacted*** or ***redacted***"


def test_scores_of_null_and_empty_texts(spark):
    df = rows(spark, [(1, "The house the"), (2, None), (3, ""), (4, "house")], "node_id int, text string")
    assert [(r.node_id, r.score) for r in retrieval.lexical_overlap(df, ["the", "house", "the"], 9).collect()] == [(1, 1.0), (4, 0.5)]
    assert [r.node_id for r in retrieval.lexical_all_terms(df, ["the", "house"], 9).collect()] == [1]


def test_dates_as_written(spark):
    want = {
        "2024/3/5": "2024-03-05", "5-3-24": "2024-03-05", "12/11/2023": "2023-11-12", "7 de Marzo de 2022": "2022-03-07", "31 días del mes de septiembre de 2021": "2021-09-31", "Octubre, 2020": "2020-10", "setiembre 2019": "2019-09",
        " 1 de enero de 2020. ": "2020-01-01", "mañana": "", "": "", "99/99/2020": "2020-99-99",
    }
    df = rows(spark, [(x,) for x in want], "raw string")
    assert {r.raw: r.iso for r in df.select("raw", T.spanish_date(F.col("raw")).alias("iso")).collect()} == want
