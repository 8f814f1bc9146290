"""Text structure: boilerplate, islands, spans, sections, packing and overlapping sentence chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import text as T


def repeated_lines(pages: DataFrame, least: int, *, document: str, page: str, text: str = "text") -> DataFrame:
    """(document, line, pages): lines that stand on at least so many different pages of a document."""
    lines = pages.select(document, page, F.explode(F.split(text, "\n")).alias("line"))
    keyed = lines.withColumn("line", T.fold_key(F.col("line"))).where("line <> ''")
    return keyed.groupBy(document, "line").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def agreeing(blocks: DataFrame, keys: list[str], position: str, *, tolerance: float = 8.0, least: int = 2) -> DataFrame:
    """Groups of least members whose positions all lie within the tolerance of their median."""
    middle = blocks.groupBy(*keys).agg(F.median(position).alias("middle"), F.count("*").alias("n"), F.min(position).alias("low"), F.max(position).alias("high"))
    return middle.withColumn("agrees", (F.col("n") >= least) & (F.col("high") - F.col("middle") <= tolerance) & (F.col("middle") - F.col("low") <= tolerance))


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: keys, value, island (from 0), first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*keys, "island", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def sections(blocks: DataFrame, *, document: str = "document_id", order: str = "ordinal", heading: str = "is_heading") -> DataFrame:
    """section: number of headings up to the block."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.sum(F.col(heading).cast("int")).over(w))


def heading_path(blocks: DataFrame, levels: int, *, document: str = "document_id", order: str = "ordinal") -> DataFrame:
    """heading_path: for each level the last heading of it that no higher one has ended since. blocks: level (null: no heading), text."""
    upto = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out, parts = blocks, []
    for k in range(1, levels + 1):
        at = F.max(F.when(F.col("level") == k, F.col(order))).over(upto)
        reset = F.max(F.when(F.col("level") < k, F.col(order))).over(upto)
        name = F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(upto)
        out = out.withColumn(f"_h{k}", F.when(at.isNotNull() & (reset.isNull() | (at > reset)), name))
        parts.append(f"_h{k}")
    return out.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop(*parts)


def page_spans(marks: DataFrame, *, document: str = "document_id", start: str = "start", length: str = "length") -> DataFrame:
    """end: the start of the next mark, or the document's length."""
    w = Window.partitionBy(document).orderBy(start)
    return marks.withColumn("end", F.coalesce(F.lead(start).over(w), F.col(length)))


def dyadic_cover(start: Column, end: Column, levels: int) -> Column:
    """Cells (level, number) of 2^level positions that together are [start, end): at most two a level, none twice."""
    start, end = start.cast("bigint"), end.cast("bigint")

    def at(k):
        size = F.lit(1 << k).cast("bigint")
        low, high = -F.floor(-start / size).cast("bigint"), F.floor(end / size).cast("bigint")
        inside = low < high
        top = F.lit(k == levels)  # whole cells of the last level, one by one
        edges = F.array(F.when(inside & (F.pmod(low, F.lit(2)) == 1), low), F.when(inside & (F.pmod(high, F.lit(2)) == 1), high - 1))
        numbers = F.when(top & inside, F.sequence(low, high - 1)).when(~top, F.array_distinct(F.array_compact(edges)))
        return F.transform(F.coalesce(numbers, F.array().cast("array<bigint>")), lambda n: F.struct(F.lit(k).alias("level"), n.alias("cell")))

    return F.flatten(F.array(*[at(k) for k in range(levels + 1)]))


def holding(points: DataFrame, intervals: DataFrame, on: list[str], *, levels: int, at: str = "at") -> DataFrame:
    """Pairs of points and the intervals [start, end) that hold them: a point looks up the cells above it, of which an interval's cover holds one at most. So no pair
    comes twice, and the work grows with the rows and pairs, not with their product."""
    up = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(at) / F.lit(1 << k)).cast("bigint").alias("cell")) for k in range(levels + 1)])
    a = points.select("*", F.explode(up).alias("_c")).select("*", "_c.level", "_c.cell").drop("_c")
    b = intervals.select("*", F.explode(dyadic_cover(F.col("start"), F.col("end"), levels)).alias("_c")).select("*", "_c.level", "_c.cell").drop("_c")
    return a.join(b, [*on, "level", "cell"]).drop("level", "cell")


def overlap(regions: DataFrame, traces: DataFrame, document: str, *, levels: int = 20) -> DataFrame:
    """Pages that each region overlaps (half-open intervals of one document): least and greatest.

    Two intervals overlap if one holds the other's start; which of the two starts first tells the cases apart."""
    r = regions.select(document, "region_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    t = traces.select(document, "page", F.col("start").alias("_from"), F.col("end").alias("_to"))
    one = holding(r.withColumn("at", F.col("_start")), t.select("*", F.col("_from").alias("start"), F.col("_to").alias("end")), [document], levels=levels)
    two = holding(t.withColumn("at", F.col("_from")), r.select("*", F.col("_start").alias("start"), F.col("_end").alias("end")), [document], levels=levels).where("_from > _start")
    pairs = one.select(document, "region_id", "page", "_start", "_end", "_from", "_to").unionByName(two.select(document, "region_id", "page", "_start", "_end", "_from", "_to")).where("_to > _start and _from < _end")
    found = pairs.groupBy(document, "region_id").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return regions.select(document, "region_id").distinct().join(found, [document, "region_id"], "left")


def pack(lines: Column, cost, limit: int | Column) -> Column:
    """Group number of every element: greedy groups whose cost stays within the limit, an element beyond it alone. The fold keeps the first elements of groups, not a
    number an element, so long arrays are not copied at every step."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("first"))

    def step(a, x):
        c = cost(x).cast("int")
        new = (a["seen"] == 0) | (a["n"] + c > limit)
        return F.struct(F.when(new, c).otherwise(a["n"] + c).alias("n"), (a["seen"] + 1).alias("seen"), F.when(new, F.concat(a["first"], F.array(a["seen"]))).otherwise(a["first"]).alias("first"))

    def spread(a):
        ends = F.concat(F.slice(a["first"], 2, F.greatest(F.size(a["first"]) - 1, F.lit(0))), F.array(a["seen"]))
        return F.when(a["seen"] > 0, F.flatten(F.transform(F.arrays_zip(a["first"].alias("first"), ends.alias("end")), lambda x, g: F.array_repeat(g, x["end"] - x["first"])))).otherwise(F.array().cast("array<int>"))

    return F.aggregate(lines, start, step, spread)


BETWEEN, WORD = re.compile(r"(?<=[.!?])\s+|\n\s*\n", re.A), re.compile(r"\S+", re.A)


@dataclass(frozen=True)
class Profile:
    """Token budgets of children: bounds, and how much a child repeats of the one before."""

    child_min: int = 250
    child_target: int = 350
    child_max: int = 450
    overlap_ratio: float = 0.12
    overlap_min: int = 30
    overlap_max: int = 60

    @property
    def overlap(self) -> int:
        return min(self.overlap_max, max(self.overlap_min, round(self.child_target * self.overlap_ratio)))


def next_start(upto: np.ndarray, at: int, least: int, goal: int, most: int) -> int:
    """Where the child that starts at sentence ``at`` ends. upto: tokens before each sentence, and of all.

    Its own tokens must come to ``least``; then it ends once they come to ``goal``, or before the sentence that would carry them beyond ``most``."""
    own = upto - upto[at]
    full, early = np.searchsorted(own, goal), np.searchsorted(own, most, side="right") - 1
    return min(len(upto) - 1, max(int(np.searchsorted(own, least)), min(int(full), max(int(early), at + 1))))


def child_starts(upto: np.ndarray, least: int, goal: int, most: int) -> list[int]:
    """First sentences of all children; a last child under ``least`` joins the one before if both fit ``most``."""
    starts, at, end = [], 0, len(upto) - 1
    while at < end:
        starts.append(at)
        at = next_start(upto, at, least, goal, most)
    if len(starts) > 1 and upto[end] - upto[starts[-1]] < least and upto[end] - upto[starts[-2]] <= most:
        starts.pop()
    return starts


def lead_in(upto: np.ndarray, before: int, at: int, profile: Profile) -> int:
    """The sentence from which the child at ``at`` repeats the one before it: the suffix whose tokens come closest to the overlap within
    its bounds, the shorter of equals; ``at`` if there is none."""
    sizes = upto[at] - upto[before:at]
    fitting = np.flatnonzero((sizes >= profile.overlap_min) & (sizes <= profile.overlap_max))[::-1]
    return before + int(fitting[np.argmin(np.abs(sizes[fitting] - profile.overlap))]) if len(fitting) else at


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where each sentence stands: parts after . ! or ? and white space, or between blank lines; trimmed, empty ones left out."""
    edges = [0, *(x for m in BETWEEN.finditer(text) for x in m.span()), len(text)]
    out = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        inner = text[a:b].strip(" \t\n\r\f\v")
        if inner:
            start = text.index(inner[0], a)
            out.append((start, start + len(inner)))
    return out


def words_of(text: str) -> int:
    """The tokens of a sentence if nothing else counts them: its words."""
    return len(WORD.findall(text))


def sentence_chunks(docs: DataFrame, profile: Profile = Profile(), *, key: str = "doc_id", text: str = "text", count: Callable[[str], int] = words_of) -> DataFrame:
    """(key, ordinal, n_sentences, n_overlap, token_count, text, char_start, char_end): children as ranges of sentences that keep to the token budgets, each
    led in by the end of the one before. count: the number of tokens of a sentence. Offsets are those of the range in the text. Null or empty texts have no children.

    A range's end is found by binary search in the running token counts of the document, so long documents take one pass."""
    bounds = (max(1, profile.child_min - profile.overlap_max), profile.child_target - profile.overlap, profile.child_max - profile.overlap_max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = sentence_spans(t or "")
                upto = np.cumsum([0, *(count(t[a:b]) for a, b in spans)])
                starts = child_starts(upto, *bounds)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(spans)], strict=False)):
                    first = lead_in(upto, starts[i - 1], a, profile) if i else a
                    row = (k, i, b - a, a - first, int(upto[b] - upto[first]), " ".join(t[x:y] for x, y in spans[first:b]), spans[first][0], spans[b - 1][1])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = (batch.column(0).type, *[pa.int32()] * 4, pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [key, "ordinal", "n_sentences", "n_overlap", "token_count", "text", "char_start", "char_end"])

    shape = f"{key} {docs.schema[key].dataType.simpleString()}, ordinal int, n_sentences int, n_overlap int, token_count int, text string, char_start int, char_end int"
    return docs.select(key, text).mapInArrow(run, shape)


def nearest_within(left: DataFrame, right: DataFrame, *, on: list[str], left_value: str, right_value: str, within: float, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key): for each left row the right row of the same ``on`` whose value is nearest, no farther than ``within``; ties to the smaller key.

    Values are cut into bins of that width and sorted there. A left row looks at the right values next to it in its bin, the highest of the bin below and the lowest of
    the bin above: never at all that lie near, so its work does not grow with them."""
    bin_of = lambda c: F.floor(F.col(c) / within)
    group = [*on, "_bin"]
    a = left.select(*on, left_key, F.col(left_value).alias("_x"), bin_of(left_value).alias("_bin")).dropna(subset=[*on, "_x"])
    b = right.dropna(subset=[*on, right_value]).where(~F.isnan(right_value)).groupBy(*on, F.col(right_value).alias("_x")).agg(F.min(right_key).alias("_key")).withColumn("_bin", bin_of("_x"))
    spot = F.struct(F.col("_x").alias("x"), F.col("_key").alias("key"))
    ends = b.groupBy(*group).agg(F.max(spot).alias("_high"), F.min(spot).alias("_low"))
    beside = ends.withColumn("_bin", F.explode(F.array(F.struct((F.col("_bin") + 1).alias("to"), F.lit(True).alias("below")), F.struct((F.col("_bin") - 1).alias("to"), F.lit(False).alias("below"))))).select(*on, F.col("_bin.to").alias("_bin"), F.when(F.col("_bin.below"), F.col("_high")).alias("_under"), F.when(~F.col("_bin.below"), F.col("_low")).alias("_over"))
    beside = beside.groupBy(*group).agg(F.max("_under").alias("_under"), F.min("_over").alias("_over"))
    rows = a.withColumn("_here", F.lit(None).cast(b.select(spot.alias("s")).schema["s"].dataType)).unionByName(b.select(*group, "_x", spot.alias("_here")), allowMissingColumns=True)
    order = Window.partitionBy(*group)
    told = lambda way: F.last("_here", ignorenulls=True).over(order.orderBy(way, F.col("_here").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = rows.withColumn("_before", told(F.asc("_x"))).withColumn("_after", told(F.desc("_x"))).where("_here is null").join(beside, group, "left")
    away = F.transform(F.array("_before", "_after", "_under", "_over"), lambda c: F.struct(F.abs(F.col("_x") - c["x"]).alias("away"), c["key"].alias("key")))
    best = asked.select(left_key, F.array_min(F.filter(away, lambda c: c["away"] <= within)).alias("_best")).where("_best is not null")
    return best.groupBy(left_key).agg(F.min("_best").alias("_best")).select(left_key, F.col("_best.key").alias(right_key))


def starts_within(rows: DataFrame, *, on: list[str], at: str, key: str, within: float) -> DataFrame:
    """(key, other): pairs of rows of the same ``on`` of which the second starts after the first, by ``within`` at most; by bins of that width."""
    bin_of = F.floor(F.col("_at") / within)
    a = rows.select(*on, F.col(key), F.col(at).alias("_from")).withColumn("_bin", F.explode(F.array(F.floor(F.col("_from") / within), F.floor(F.col("_from") / within) + 1)))
    b = rows.select(*on, F.col(key).alias("other"), F.col(at).alias("_at")).withColumn("_bin", bin_of)
    return a.join(b, [*on, "_bin"]).where((F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_from") + within)).select(key, "other")
