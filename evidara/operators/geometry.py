"""Boxes on pages: the nearest label of a control in two dimensions, and blocks that stand in the same place on many pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import lineage

#: Middles of one line lie no farther apart; share of a page that is header or footer; tolerance of positions; least pages.
SAME_LINE, BAND, TOLERANCE, LEAST_PAGES = 12.0, 0.16, 8.0, 2
#: Labels that a first search is to find.
FEW = 4


def _cell(value: Column, level: Column) -> Column:
    """The cell that holds a value; cells are twice as wide as the radius 2^level of a search."""
    return F.floor(value / F.pow(F.lit(2.0), level + 1)).cast("bigint")


def _touched(value: Column, level: Column, *sides: int) -> Column:
    """Cells that a search from a value to these sides (-1, 0, 1) looks into: two at most."""
    return F.array_distinct(F.array(*[_cell(value + side * F.pow(F.lit(2.0), level), level) for side in sides]))


def _widen(asked: DataFrame, boxes: DataFrame, on: list[str], cells, of_box, fits: Column, page: str) -> DataFrame:
    """(page, control_id, label_id) of the boxes at the least cost. asked: page, control_id, x0, top, middle, level, last.

    Round by round the radius grows fourfold. A control looks into the cells that its radius touches, which hold all boxes as near as that; once its best
    box is that near, or the radius is as wide as the page, it is done."""
    cost = F.abs(F.col("bottom") - F.col("top")) + F.abs(F.col("x1") - F.col("x0"))
    out, grown = None, 0
    while True:
        at = boxes.withColumn("level", F.col("level") + grown)
        at = at.select(page, "label_id", "x1", "bottom", "label_middle", *[c.alias(n) for n, c in zip(on, of_box, strict=True)])
        near = asked.select(page, "control_id", "x0", "top", "middle", F.explode(cells).alias("_cell")).select("*", *[F.col("_cell")[n].alias(n) for n in on])
        found = near.join(at, [page, *on]).where(fits).groupBy(page, "control_id").agg(F.min(F.struct(cost.alias("cost"), F.col("label_id"))).alias("best"))
        judged = lineage.cut(asked.join(found, [page, "control_id"], "left").withColumn("done", (F.col("level") >= F.col("last")) | F.coalesce(F.col("best.cost") <= F.pow(F.lit(2.0), F.col("level")), F.lit(False))))
        here = judged.where("done and best is not null").select(page, "control_id", F.col("best.label_id").alias("label_id"))
        out = here if out is None else out.unionByName(here)
        left = judged.where("not done")
        if left.isEmpty():
            return out
        asked, grown = left.withColumn("level", F.col("level") + 2).drop("best", "done"), grown + 2


def nearest_labels(controls: DataFrame, labels: DataFrame, *, page: str = "page", line: float = SAME_LINE) -> DataFrame:
    """(page, control_id, label_id, same_line) of controls(page, control_id, x0, top, x1, bottom) and labels(page, label_id, x0, top, x1, bottom).

    Labels on the control's line that end to its left come first; else all labels of the page. Of these the one whose right bottom corner is nearest to the
    control's left top corner (Manhattan distance; ties to the smaller id). Ids are unique on a page; boxes with a null side take no part. Labels lie in a grid whose cells hold a few each,
    and controls look into few of them, so a page of many boxes makes no pairs of all with all. The first radius is one in which some labels are to be expected, by the
    page's area for each label, so that most controls are done in the first round however many boxes a page holds."""
    whole = lambda df: df.dropna(subset=[page, "x0", "top", "x1", "bottom"])
    asked = whole(controls).select(page, "control_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "top")], ((F.col("top") + F.col("bottom")) / 2).alias("middle"))
    boxes = whole(labels).select(page, "label_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "bottom")], ((F.col("top") + F.col("bottom")) / 2).alias("label_middle"))
    ends = lambda df, x, y: df.groupBy(page).agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n"))
    a, b = ends(asked, "x0", "top"), ends(boxes, "x1", "bottom").withColumnRenamed("n", "boxes")
    wide = F.greatest("high_x0", "high_x1") - F.least("low_x0", "low_x1")
    high = F.greatest("high_top", "high_bottom") - F.least("low_top", "low_bottom")
    level = lambda x: F.floor(F.log2(F.greatest(x, F.lit(1.0))))
    up = lambda x: F.ceil(F.log2(F.greatest(x, F.lit(1.0))))
    each = FEW * wide * high / F.col("boxes")  # the area that holds FEW labels; on a line it is as high as the line, but no wider than high if labels lie close
    sizes = a.join(b, page).select(page, up(F.sqrt(each / 2)).alias("level"), (level(F.greatest(wide, high)) + 1).alias("last"), up(F.greatest(F.sqrt(each), each / (2 * line))).alias("line_level"))
    asked, boxes = lineage.cut(asked.join(sizes, page)), lineage.cut(boxes.join(sizes.drop("last"), page))
    # same line: bands of a few lines, cells to the left; controls with no label's end to their left on lines that touch theirs need not look
    on_line = lambda c: F.floor(c / line).cast("bigint")
    leftmost = lineage.cut(boxes.groupBy(page, on_line(F.col("label_middle")).alias("_line")).agg(F.min("x1").alias("leftmost")))
    lined = asked
    for i in (-1, 0, 1):
        lined = lined.withColumn("_line", on_line(F.col("middle")) + i).join(leftmost.withColumnRenamed("leftmost", f"_left{i + 1}"), [page, "_line"], "left").drop("_line")
    lined = lined.where(F.least("_left0", "_left1", "_left2") <= F.col("x0")).drop("_left0", "_left1", "_left2").withColumn("level", F.col("line_level"))
    band = lambda c: F.floor(c / (4 * line)).cast("bigint")
    bands = F.array_distinct(F.array(band(F.col("middle") - line), band(F.col("middle") + line)))
    cells = F.flatten(F.transform(bands, lambda i: F.transform(_touched(F.col("x0"), F.col("level"), -1, 0), lambda j: F.struct(i.alias("band"), j.alias("cx")))))
    fits = (F.abs(F.col("label_middle") - F.col("middle")) <= line) & (F.col("x1") <= F.col("x0"))
    near = _widen(lined, boxes.withColumn("level", F.col("line_level")), ["band", "cx"], cells, [band(F.col("label_middle")), _cell(F.col("x1"), F.col("level"))], fits, page)
    rest = asked.join(near, [page, "control_id"], "left_anti")
    cells = F.flatten(F.transform(_touched(F.col("x0"), F.col("level"), -1, 1), lambda i: F.transform(_touched(F.col("top"), F.col("level"), -1, 1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
    far = _widen(rest, boxes, ["cx", "cy"], cells, [_cell(F.col("x1"), F.col("level")), _cell(F.col("bottom"), F.col("level"))], F.lit(True), page)
    return near.withColumn("same_line", F.lit(True)).unionByName(far.withColumn("same_line", F.lit(False)))


def regions(blocks: DataFrame, *, band: float = BAND) -> DataFrame:
    """blocks(top, bottom, page_height, region) with ``place``: header or footer as told, else by the band at the page's ends; null for all others."""
    told = F.lower("region")
    place = F.when(told.isin("header", "footer"), told).when((F.col("page_height") > 0) & (F.col("top") <= F.col("page_height") * band), "header").when((F.col("page_height") > 0) & (F.col("bottom") >= F.col("page_height") * (1 - band)), "footer")
    return blocks.withColumn("place", place)


def consensus(blocks: DataFrame, *, document: str = "document_id", least: int = LEAST_PAGES, tolerance: float = TOLERANCE, band: float = BAND) -> DataFrame:
    """(document, place, line, pages, n, agrees): header and footer texts on several pages of a document, and whether all their blocks keep to the medians of top and
    bottom. blocks(document, page, block_id, text, top, bottom, page_height, region, role); watermarks, empty texts and blocks without a place take no part.

    Positions are counted first, so the second stage has one row for each place a text stands in, however many pages there are."""
    keyed = regions(blocks, band=band).withColumn("line", F.lower(T.normalize_text(F.col("text"))))
    keyed = keyed.where((F.col("line") != "") & F.col("place").isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull() & (F.lower(F.coalesce("role", F.lit(""))) != "watermark"))
    group = [document, "place", "line"]
    spots = keyed.groupBy(*group, "top", "bottom").agg(F.count("*").alias("k"))
    ends = [_weighted_median(c).alias(f"mid_{c}") for c in ("top", "bottom")]
    stands = spots.groupBy(*group).agg(*ends, *[f(c).alias(f"{n}_{c}") for c in ("top", "bottom") for n, f in (("low", F.min), ("high", F.max))], F.sum("k").alias("n"))
    pages = keyed.select(*group, "page").distinct().groupBy(*group).agg(F.count("*").alias("pages"))
    agrees = F.lit(True)
    for c in ("top", "bottom"):
        agrees = agrees & (F.col(f"high_{c}") - F.col(f"mid_{c}") <= tolerance) & (F.col(f"mid_{c}") - F.col(f"low_{c}") <= tolerance)
    return stands.join(pages, group).where(F.col("pages") >= least).select(*group, "pages", "n", agrees.alias("agrees"))


def _weighted_median(column: str) -> Column:
    """Of values that stand k times each."""
    return F.expr(f"percentile({column}, 0.5, k)")


def removed(blocks: DataFrame, *, document: str = "document_id", least: int = LEAST_PAGES, tolerance: float = TOLERANCE, band: float = BAND) -> DataFrame:
    """(document, page, block_id, text, reason) of the blocks that a consensus takes out of the indexable text."""
    found = consensus(blocks, document=document, least=least, tolerance=tolerance, band=band).where("agrees").select(document, "place", "line")
    keyed = regions(blocks, band=band).withColumn("line", F.lower(T.normalize_text(F.col("text")))).where((F.lower(F.coalesce("role", F.lit(""))) != "watermark") & F.col("top").isNotNull() & F.col("bottom").isNotNull())
    return keyed.join(found, [document, "place", "line"], "left_semi").select(document, "page", "block_id", "text", F.concat(F.lit("repeated_"), "place").alias("reason"))


def body(blocks: DataFrame, gone: DataFrame, *, document: str = "document_id", order: str = "ordinal") -> DataFrame:
    """(document, page, text): the texts of the blocks that stay, in order, normalised. Pages that lose all blocks have an empty text."""
    kept = blocks.join(gone.select(document, "page", "block_id"), [document, "page", "block_id"], "left_anti").where(F.coalesce("text", F.lit("")) != "")
    texts = kept.groupBy(document, "page").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("lines"))
    made = texts.select(document, "page", T.normalize_text(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("text"))
    return blocks.select(document, "page").distinct().join(made, [document, "page"], "left").select(document, "page", F.coalesce("text", F.lit("")).alias("text"))


def watermarks(blocks: DataFrame, *, document: str = "document_id") -> DataFrame:
    """(document, text, pages): watermarks are observed and stay."""
    seen = blocks.where((F.lower("role") == "watermark") & (F.coalesce("text", F.lit("")) != ""))
    return seen.groupBy(document, "text").agg(F.countDistinct("page").alias("pages"))
