"""Markdown documents as blocks, parents and children. A document's lines are one window partition; everything else stays in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import ids
from evidara.operators import structure

#: Patterns of headings, numbered headings, list items, page markers, front matter, change histories and dates.
HEADING = r"^#{1,6}[ \t]+[^ \t]"
ARTICLE = r"(?i)^(art[ií]culo[ \t]+[0-9]+|[0-9]+\.[0-9]+(\.[0-9]+)*)"
LIST = r"^([-*+][ \t]+|[0-9]+[.)][ \t]+)."
MARKER = r"^<!--[ \t]*page:[ \t]*([0-9]+)[ \t]*-->$"
FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
HISTORY = r"(?i)(historial|control)[ \t]+de[ \t]+(cambios|versiones)|versi[oó]n.*fecha"
DATE = (
    r"(?i)([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|[0-9]{1,2}[ \t]+de[ \t]+[a-z]+[ \t]+de[ \t]+[0-9]{4})"
)


def front_matter_values(markdown: Column) -> Column:
    """The key: value lines between the leading --- lines as a map (the last of equal keys stays); an empty map without front matter."""
    lines = F.filter(F.split(F.regexp_extract(markdown, FRONT, 1), "\r?\n"), lambda x: F.instr(x, ":") > 0)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))))
    pairs = F.transform(lines, pair)
    named = F.transform(pairs, lambda x: x["col1"])
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(named, i + 2, F.size(named)), x["col1"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))


def pipe_cells(line: Column) -> Column:
    """The trimmed cells of a table row written with pipes."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))


def lines(docs: DataFrame, *, key: str = "document_id", text: str = "markdown") -> DataFrame:
    """(key, line_no, line, start, end, page): trimmed lines with the character offsets of the document; page is that of the last marker, null
    before the first. Null or empty texts have no lines."""
    body = F.length(F.regexp_extract(text, FRONT, 0))
    split = docs.where(F.length(text) > 0).select(F.col(key), body.alias("_body"), F.posexplode(F.split(text, "\n")).alias("line_no", "_raw"))
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("_raw") + 1).over(upto) - F.length("_raw") - 1
    line = F.regexp_replace("_raw", r"^[ \t\r\f]+|[ \t\r\f]+$", "")
    placed = split.select(key, "line_no", line.alias("line"), start.alias("start"), (start + F.length(F.regexp_replace("_raw", r"\r$", ""))).alias("end"), "_body")
    number = F.when(F.col("line").rlike(MARKER), F.regexp_extract("line", MARKER, 1).cast("int"))
    return placed.where("start >= _body").withColumn("page", F.last(number, ignorenulls=True).over(upto)).drop("_body")


def _classified(found: DataFrame, key: str) -> DataFrame:
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    onward = upto.rowsBetween(0, Window.unboundedFollowing)
    opens, closes = F.col("line").startswith("<table"), F.col("line").contains("</table>")
    marked = found.withColumns({
        "_open": F.max(F.when(opens, F.col("line_no"))).over(upto),
        "_closed": F.max(F.when(closes, F.col("line_no"))).over(before),
        "_close": F.min(F.when(closes, F.col("line_no"))).over(onward),
    })
    inside = F.col("_open").isNotNull() & F.col("_close").isNotNull() & (F.col("_closed").isNull() | (F.col("_closed") < F.col("_open")))
    kind = (
        F.when(inside, "html_table").when(F.col("line") == "", "blank").when(F.col("line").rlike(HEADING), "heading").when(F.col("line").rlike(LIST), "list")
        .when(F.col("line").rlike(ARTICLE), "article").when(F.col("line").startswith("|"), "table").otherwise("paragraph")
    )
    return marked.withColumn("_kind", kind)


def regions(docs: DataFrame, *, key: str = "document_id", text: str = "markdown") -> DataFrame:
    """(key, ordinal, kind, level, text, char_start, char_end, page_start, page_end): headings (# or numbered articles, each alone), lists, tables
    (pipes or HTML) and paragraphs in order. Blank lines and changes of kind end a block; page markers and front matter are no content."""
    w = Window.partitionBy(key).orderBy("line_no")
    kept = _classified(lines(docs, key=key, text=text).where(~F.col("line").rlike(MARKER)), key)
    former = F.lag("_kind").over(w)
    again = former.isNull() | (former != F.col("_kind")) | F.col("_kind").isin("heading", "article") | ((F.col("_kind") == "html_table") & (F.col("_open") == F.col("line_no")))
    numbered = kept.withColumn("ordinal", F.sum((again & (F.col("_kind") != "blank")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    label = F.regexp_extract("line", ARTICLE, 1)
    level = F.when(F.col("_kind") == "heading", F.length(F.regexp_extract("line", "^#+", 0))).when(
        F.col("_kind") == "article", F.when(label.rlike("(?i)^art"), 1).otherwise(F.least(F.lit(6), F.length(label) - F.length(F.replace(label, F.lit("."))) + 1))
    )
    content = F.when(F.col("_kind") == "heading", F.regexp_replace("line", "^#+[ \t]+", "")).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), content.alias("t"))))
    blocks = numbered.where("_kind <> 'blank'").groupBy(key, "ordinal").agg(
        F.min("_kind").alias("_kind"), F.min(level).alias("level"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"),
        F.min("start").alias("char_start"), F.max("end").alias("char_end"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    kind = F.when(F.col("_kind") == "article", "heading").when(F.col("_kind") == "html_table", "table").otherwise(F.col("_kind"))
    return blocks.select(key, "ordinal", kind.alias("kind"), "level", "text", "char_start", "char_end", "page_start", "page_end")


def tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def parents(blocks: DataFrame, limit: int = 1500, *, key: str = "document_id", count: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, ordinal, parent_id, kind, text, token_count, n_blocks, char_start, char_end, page_start, page_end, blocks): a heading opens a section, headings
    alone join the section after them; sections beyond the limit are cut greedily between blocks, but not those with a table. The page span is
    null if any block has none. kind is table if a block is one. count: the number of tokens of a text."""
    w = Window.partitionBy(key).orderBy("ordinal")
    heads = F.col("kind") == "heading"
    opens = heads & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "heading")
    cut = blocks.withColumn("section", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fields = ["ordinal", "kind", "text", "char_start", "char_end", "page_start", "page_end"]
    whole = cut.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct(*fields, count(F.col("text")).alias("n")))).alias("b"), F.bool_or(F.col("kind") == "table").alias("table"))
    groups = F.when(F.col("table"), F.transform("b", lambda x: F.lit(0))).otherwise(structure.pack(F.col("b"), lambda x: x["n"], limit))
    rows = whole.select(key, "section", "table", F.explode(F.arrays_zip(F.col("b"), groups.alias("g"))).alias("x")).select(key, "section", "table", "x.b.*", F.col("x.g").alias("g"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n")
    paged = F.count("page_start") == F.count("*")
    made = rows.groupBy(key, "section", "g").agg(
        F.min("ordinal").alias("_first"), F.array_sort(F.collect_list(F.struct("ordinal", "kind", "text"))).alias("blocks"), F.when(F.bool_or("table"), "table").otherwise("text").alias("kind"), text.alias("text"), F.sum("n").alias("token_count"), F.count("*").alias("n_blocks"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.when(paged, F.min("page_start")).alias("page_start"), F.when(paged, F.max("page_end")).alias("page_end"),
    )
    numbered = made.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1)
    return numbered.select(key, "ordinal", ids.fenced("par_", key, "ordinal", "text").alias("parent_id"), "kind", "text", "token_count", "n_blocks", "char_start", "char_end", "page_start", "page_end", "blocks")


def segments(found: DataFrame) -> DataFrame:
    """(parent_id, segment, kind, text) of parents: each table is a segment of its own, and so is every run of other blocks."""
    w = Window.partitionBy("parent_id").orderBy("ordinal")
    rows = found.select("parent_id", F.explode("blocks").alias("b")).select("parent_id", "b.*")
    tabular = F.col("kind") == "table"
    opens = tabular | F.coalesce(F.lag(tabular).over(w), F.lit(True))
    cut = rows.withColumn("tabular", tabular).withColumn("segment", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n")
    return cut.groupBy("parent_id", "segment").agg(F.when(F.bool_or("tabular"), "table").otherwise("text").alias("kind"), text.alias("text"))


def table_groups(tables: DataFrame, limit: int, *, key: str = "parent_id", text: str = "text", count: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, ordinal, context_prefix, text, token_count): the rows of each table in greedy groups that fit the limit with the header; the header (two
    lines before pipes, else one) leads the first group as text and is the context of the others."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n_head = F.when((F.size("rows") >= 2) & F.element_at("rows", 1).startswith("|"), 2).otherwise(1)
    cut = tables.select(F.col(key), rows.alias("rows")).where("size(rows) > 0").withColumn("n_head", n_head)
    cut = cut.select(key, F.slice("rows", 1, F.col("n_head")).alias("head"), F.slice("rows", F.col("n_head") + 1, F.size("rows")).alias("data"))
    cut = cut.withColumn("head", F.array_join("head", "\n")).withColumn("g", structure.pack(F.col("data"), count, F.lit(limit) - count(F.col("head"))))
    rows = cut.select(key, "head", F.posexplode_outer(F.arrays_zip("data", "g")).alias("i", "x")).select(key, "head", "i", F.col("x.data").alias("row"), F.coalesce("x.g", F.lit(0)).alias("ordinal"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]), "\n")
    made = rows.groupBy(key, "ordinal").agg(F.first("head").alias("head"), body.alias("body"))
    out = made.select(
        key, "ordinal", F.when(F.col("ordinal") == 0, "").otherwise(F.col("head")).alias("context_prefix"),
        F.when((F.col("ordinal") == 0) & (F.col("body") != ""), F.concat_ws("\n", "head", "body")).when(F.col("ordinal") == 0, F.col("head")).otherwise(F.col("body")).alias("text"),
    )
    return out.withColumn("token_count", tokens(F.col("context_prefix")) + tokens(F.col("text")))


def children(found: DataFrame, profile: structure.Profile = structure.Profile()) -> DataFrame:
    """(parent_id, ordinal, kind, context_prefix, text, token_count) of parents. A parent without a table that fits the largest child is one child (atomic).
    The others are taken by segments: tables by groups of rows, text that fits whole, and longer text by sentences with overlap.
    Parents without a column of blocks are one block each."""
    if "blocks" not in found.columns:
        found = found.withColumn("blocks", F.array(F.struct(F.lit(0).alias("ordinal"), "kind", "text")))
    found = found.withColumn("token_count", tokens(F.col("text")))
    whole = (F.col("kind") != "table") & (F.col("token_count") <= profile.child_max)
    atomic = found.where(whole).select("parent_id", F.lit(0).alias("segment"), F.lit(0).alias("place"), F.lit("atomic").alias("kind"), F.lit("").alias("context_prefix"), "text", "token_count")
    parts = segments(found.where(~whole)).withColumn("part_id", F.struct("parent_id", "segment")).withColumn("n", tokens(F.col("text")))
    back = lambda df, kind: df.select("part_id.parent_id", "part_id.segment", F.col("ordinal").alias("place"), F.lit(kind).alias("kind"), "context_prefix", "text", "token_count")
    text = parts.where("kind <> 'table'")
    short = text.where(F.col("n") <= profile.child_max).select("part_id", F.lit(0).alias("ordinal"), F.lit("").alias("context_prefix"), "text", F.col("n").alias("token_count"))
    long = structure.sentence_chunks(text.where(F.col("n") > profile.child_max), profile, key="part_id").withColumn("context_prefix", F.lit(""))
    rows = atomic.unionByName(back(short, "text")).unionByName(back(long, "text")).unionByName(back(table_groups(parts.where("kind = 'table'"), profile.child_max, key="part_id"), "table"))
    numbered = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("parent_id").orderBy("segment", "place")) - 1)
    return numbered.select("parent_id", "ordinal", "kind", "context_prefix", "text", "token_count")


def history_entries(rows: DataFrame, keys: list[str], order: str, *, line: str = "line") -> DataFrame:
    """(keys, order, version, date, description) of change histories: dated table rows after a history heading. Before the first such row a # line
    ends the history, after it any line that is no dated row does."""
    cells = pipe_cells(F.col(line))
    header = F.col(line).rlike(HISTORY)
    dated = ~header & F.col(line).startswith("|") & (F.size(cells) >= 2) & F.exists(cells, lambda c: c.rlike(DATE))
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select(*keys, order, F.col(line).alias("_line"), cells.alias("_cells"), header.alias("_header"), dated.alias("_dated"))
    marked = marked.withColumns({"_run": F.sum(F.col("_header").cast("int")).over(upto), "_at": F.row_number().over(upto)}).where("_run > 0")
    inner = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({
        "_first": F.min(F.when(F.col("_dated"), F.col("_at"))).over(inner), "_n": F.sum(F.col("_dated").cast("int")).over(inner),
        "_stop": F.max(F.when(~F.col("_header"), F.col("_line").startswith("#"))).over(inner),
    }).where("_dated and not coalesce(_stop, false) and _at - _first + 1 = _n")
    out = marked.withColumn("version", F.try_element_at(F.filter("_cells", lambda c: c.rlike(r"(?i)^v?(ersi[oó]n[ \t]*)?[A-Za-z0-9._-]+$")), F.lit(1)))
    out = out.withColumn("date", F.try_element_at(F.filter("_cells", lambda c: c.rlike(DATE)), F.lit(1)))
    other = F.filter("_cells", lambda c: (c != "") & ~c.eqNullSafe(F.col("version")) & ~c.eqNullSafe(F.col("date")))
    return out.select(*keys, order, "version", "date", F.try_element_at(other, F.lit(1)).alias("description"))
