"""Nearest labels, overlapping intervals and headers by consensus against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from evidara.operators import geometry as G
from evidara.operators import structure as S

BOX = "page int, %s int, x0 double, top double, x1 double, bottom double, label_middle int, level int"


def boxes(spark, rows, name):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], BOX % name)


def nearest(controls, labels):
    out = {}
    for p, i, x0, top, _, bottom in controls:
        pool = [(abs(lb - top) + abs(lx1 - x0), j, abs((lt + lb) / 2 - (top + bottom) / 2) <= 12 and lx1 <= x0) for q, j, _, lt, lx1, lb in labels if q == p]
        pool = [x for x in pool if x[2]] or pool
        if pool:
            out[p, i] = (min(pool)[1], min(pool)[2])
    return out


@pytest.mark.parametrize("seed", (1, 2))
def test_nearest_labels(spark, seed):
    rng = random.Random(seed)

    def some(n, wide, high):
        return [(p, i + 1000 * p, x := float(rng.randint(-wide, wide)), y := float(rng.randint(0, high)), x + rng.choice((1.0, 30.0)), y + rng.choice((4.0, 12.0, 40.0))) for p, wide, high in ((0, wide, high), (1, 20, 10), (2, 3 * wide, 5)) for i in range(n)]

    controls, labels = some(40, 600, 800), some(30, 600, 800)
    controls += [(7, 9000, 1.0, 1.0, 2.0, 2.0), (0, 9001, None, 1.0, 2.0, 2.0)]  # a page without labels, a box without a side
    got = {(r.page, r.control_id): (r.label_id, r.same_line) for r in G.nearest_labels(boxes(spark, controls, "control_id"), boxes(spark, labels, "label_id")).collect()}
    assert got == nearest([c for c in controls if c[2] is not None], labels)


def test_many_boxes_on_one_page(spark):
    """100,000 boxes: every control has its label 20 to the left; the joins make few pairs each."""
    rows = spark.range(50_000).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("control_id"), ((F.col("id") % 250) * 100 + 50).cast("double").alias("x0"), (F.floor(F.col("id") / 250) * 40).cast("double").alias("top"))
    controls = rows.withColumn("x1", F.col("x0") + 5).withColumn("bottom", F.col("top") + 5)
    labels = controls.select("page", F.col("control_id").alias("label_id"), (F.col("x0") - 50).alias("x0"), "top", (F.col("x0") - 20).alias("x1"), "bottom")
    got = G.nearest_labels(controls, labels).agg(F.count("*").alias("n"), F.count_if(F.col("control_id") == F.col("label_id")).alias("own")).first()
    assert tuple(got) == (50_000, 50_000)


def test_overlap_is_the_theta_join(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.randint(0, 3), i, a := rng.randint(-40, 400), a + rng.choice((0, 1, 2, 7, 64, 300, -5))) for i in range(n)]
    regions, traces = some(80), some(90)
    got = {(r.d, r.region_id): (r.page_start, r.page_end) for r in S.overlap(spark.createDataFrame(regions, "d int, region_id int, start int, end int"), spark.createDataFrame(traces, "d int, page int, start int, end int"), "d", levels=6).collect()}
    want = {}
    for d, i, a, b in regions:
        hits = [p for e, p, x, y in traces if e == d and y > a and x < b]
        want[d, i] = (min(hits, default=None), max(hits, default=None))
    assert got == want


def test_cover_is_exact(spark):
    rows = [(a, b) for a in (-9, 0, 1, 5, 63, 64) for b in (a, a + 1, a + 2, a + 17, a + 200)]
    for r in spark.createDataFrame(rows, "start int, end int").select("start", "end", S.dyadic_cover(F.col("start"), F.col("end"), 5).alias("c")).collect():
        cells = [x for k, n in r.c for x in range(n << k, (n + 1) << k)]
        assert sorted(cells) == list(range(r.start, r.end)) and len(r.c) <= 2 * 5 + 8


def test_dense_document_makes_few_pairs(spark):
    """100,000 regions of one document, each over two traces."""
    n = 100_000
    regions = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("region_id"), (F.col("id") * 10 + 5).alias("start"), (F.col("id") * 10 + 15).alias("end"))
    traces = spark.range(n + 1).select(F.lit(1).alias("d"), F.col("id").alias("page"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    got = S.overlap(regions, traces, "d", levels=4).where((F.col("page_start") == F.col("region_id")) & (F.col("page_end") == F.col("region_id") + 1)).count()
    assert got == n


SCHEMA = "document_id int, page int, ordinal int, block_id string, text string, top double, bottom double, page_height double, region string, role string"


def page(n, *blocks):
    return [(1, n, i, f"p{n}_{i}", t, a, b, 792.0, region, role) for i, (t, a, b, region, role) in enumerate(blocks)]


def judged(spark, *pages):
    blocks = spark.createDataFrame([x for p in pages for x in p], SCHEMA)
    gone = G.removed(blocks)
    return {(r.page, r.text): r.reason for r in gone.collect()}, {r.page: r.text for r in G.body(blocks, gone).collect()}, {r.text: r.pages for r in G.watermarks(blocks).collect()}


def test_repeated_headers_and_footers_go(spark):
    gone, body, _ = judged(
        spark, page(1, ("SYC Seguridad y Salud", 20.0, 38.0, None, None), ("Primer cuerpo", 150.0, 180.0, None, None), ("Pagina 1 de 2", 760.0, 775.0, None, None)), page(2, ("SYC  seguridad y Salud", 22.0, 40.0, None, None), ("Segundo cuerpo", 150.0, 180.0, None, None), ("Pagina 1 de 2", 758.0, 773.0, None, None))
    )
    assert body == {1: "Primer cuerpo", 2: "Segundo cuerpo"} and set(gone.values()) == {"repeated_header", "repeated_footer"} and len(gone) == 4


def test_blocks_must_repeat_and_agree(spark):
    apart = judged(spark, page(1, ("CONTROLADO", 20.0, 38.0, None, None)), page(2, ("CONTROLADO", 300.0, 318.0, None, None)))
    told = judged(spark, page(1, ("X", 20.0, 38.0, "Header", None)), page(2, ("X", 300.0, 318.0, "header", None)))
    once = judged(spark, page(1, ("Y", 20.0, 38.0, None, None), ("Y", 21.0, 38.0, None, None)))
    member = judged(spark, page(1, ("Z", 20.0, 38.0, None, None)), page(2, ("Z", 20.0, 38.0, None, None)), page(3, ("Z", 29.0, 38.0, None, None)))
    assert not apart[0] and not told[0] and not once[0] and not member[0] and apart[1] == {1: "CONTROLADO", 2: "CONTROLADO"}


def test_watermarks_stay(spark):
    gone, body, seen = judged(spark, page(1, ("COPIA", 30.0, 60.0, None, "watermark"), ("Contenido", 100.0, 130.0, None, None)), page(2, ("COPIA", 32.0, 62.0, None, "Watermark"), (None, 100.0, 130.0, None, None)))
    assert not gone and seen == {"COPIA": 2} and "COPIA" in body[1] and body[2] == "COPIA"


def test_close_labels_are_found_in_the_first_round(spark, monkeypatch):
    """A page with a label on every 14 units of area, as large tables have: the first radius suits it, so nearly no control is asked again."""
    rng = random.Random(9)
    some = lambda n: [(0, i, x := float(rng.randint(0, 170)), y := float(rng.randint(0, 170)), x + 12.0, y + 7.0) for i in range(n)]
    controls, labels = some(300), some(2000)
    judged, cut = [], G.lineage.cut
    monkeypatch.setattr(G.lineage, "cut", lambda df: judged.append(cut(df)) or judged[-1])
    got = {(r.page, r.control_id): (r.label_id, r.same_line) for r in G.nearest_labels(boxes(spark, controls, "control_id"), boxes(spark, labels, "label_id")).collect()}
    assert got == nearest(controls, labels)
    first = next(x for x in judged if "done" in x.columns)
    assert first.where("not done").count() * 10 < first.count()
