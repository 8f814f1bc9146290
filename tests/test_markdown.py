"""Markdown blocks, parents, children and change histories on hand-made frames."""

from pyspark.sql import functions as F

from evidara.operators import markdown as M
from evidara.operators import structure as S

TEXT = "---\ntitle: Manual: uno\nlang: es\ntitle: dos\n---\n<!-- page: 1 -->\n# Alcance\n\nPrimera línea\r\nsegunda\n<!-- page: 2 -->\n- a\n- b\n\nArtículo 5 Uso\n1.2.3 Fin\n<table><tr>\n\n<td>x</td></tr></table>\n| a | b |\n|---|---|\n| 1 | 2 |\n<table> sin fin"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id int, markdown string")


def test_regions(spark):
    got = M.regions(frame(spark, TEXT, None, "", "\n \n")).orderBy("document_id", "ordinal").collect()
    assert [(r.kind, r.level, r.page_start, r.page_end) for r in got] == [
        ("heading", 1, 1, 1), ("paragraph", None, 1, 1), ("list", None, 2, 2), ("heading", 1, 2, 2), ("heading", 3, 2, 2), ("table", None, 2, 2), ("table", None, 2, 2), ("paragraph", None, 2, 2),
    ]
    assert [r.text for r in got[:3]] == ["Alcance", "Primera línea\nsegunda", "- a\n- b"]
    assert TEXT[got[1].char_start : got[1].char_end] == "Primera línea\r\nsegunda" and TEXT[got[5].char_start : got[5].char_end].endswith("</table>")
    assert {r.document_id for r in got} == {0}


def test_front_matter_values(spark):
    got = [r[0] for r in frame(spark, TEXT, "none", "---\n---\n").select(M.front_matter_values(F.col("markdown"))).collect()]
    assert got == [{"title": "dos", "lang": "es"}, {}, {}]


def test_parents_join_headings_and_cut_long_sections(spark):
    text = "# A\n## B\n\nuno dos tres\n\ncuatro cinco\n\nseis\n\n# T\n\n| a |\n|---|\n| 1 |\n\nlargo texto tras la tabla\n\n# Z\n# Y"
    got = M.parents(M.regions(frame(spark, text)), 5).orderBy("ordinal").collect()
    assert [(r.kind, r.n_blocks) for r in got] == [("text", 3), ("text", 2), ("table", 3), ("text", 2)]
    assert got[0].text == "A\n\nB\n\nuno dos tres" and got[0].page_start is None
    assert len({r.parent_id for r in got}) == 4


def test_children_of_tables_repeat_the_header(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(5))
    rows = spark.createDataFrame([("p", "table", table), ("q", "text", "Uno dos. Tres cuatro."), ("r", "table", "solo")], "parent_id string, kind string, text string")
    got = M.children(rows, S.Profile(1, 2, 17, 0.12, 1, 1)).orderBy("parent_id", "ordinal").collect()
    assert [(r.parent_id, r.ordinal, r.context_prefix != "", r.text.count("x")) for r in got if r.parent_id != "q"] == [("p", 0, False, 2), ("p", 1, True, 2), ("p", 2, True, 1), ("r", 0, False, 0)]
    assert all(r.token_count <= 17 for r in got)


def test_history(spark):
    lines = ["Control de cambios", "texto", "| Versión | Fecha | Nota |", "|---|---|", "| v1 | 01/02/2024 | alta |", "| 2 | 3 de mayo de 2024 | |", "fin", "| 3 | 01/02/2025 | fuera |", "Historial de versiones", "# corte", "| 4 | 01/02/2026 | fuera |"]
    got = M.history_entries(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d int, n int, line string"), ["d"], "n").orderBy("n").collect()
    assert [(r.n, r.version, r.date, r.description) for r in got] == [(4, "v1", "01/02/2024", "alta"), (5, "2", "3 de mayo de 2024", None)]
